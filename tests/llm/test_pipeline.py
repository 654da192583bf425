"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_and_result():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_pass_on_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} of the little corpus that we keep, line one {i * 977}\nshared line of all the documents in this corpus", "en", "s" + str(i % 3), 5, "extra") for i in range(40)] + [(40, None, None, None, None, None), (41, "", "en", "s0", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
    assert sum("shared line" in (r.text or "") for r in held.dropDuplicates(["doc_id"]).collect()) == 1
    pieces = corpus_pipeline.pack(spark, held, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in held.collect())
