"""Columns of the input keep their values, whatever operators call theirs."""

import pytest
from pyspark.sql import functions as F

from tesserae.llm import fingerprints, lines, mixing, neardup, urls

#: What operators have called columns of their own, or make.
NAMES = [
    "dropped", "n_lines", "_place", "_tie", "_source", "_s", "_p", "_b", "_blocks", "_passes", "_key", "_drawn", "_stop_key", "_url", "_rule", "__scored", "_form", "_digest", "_d", "_f", "_n", "place", "node", "root", "url",
    "fingerprint", "pass_no", "block", "turn", "at", "host", "rule", "score", "verdict", "one", "two", "bands", "line", "again", "lines", "gram",
]
TEXTS = ["one line here\nand another line", "one line here\nand another line", "a third text of its own", None, "", "a third text of its own!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 5, t, "s" + str(i % 2), f"http://h{i}.net/de/{i}", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, link string, row long")
    return df.select("*", *[F.concat(F.lit(n + "-"), F.col("row").cast("string")).alias(n) for n in NAMES])


CASES = {
    "lines": (lines.dedup, {"dropped", "n_lines"}),
    "neardup": (neardup.keep_one, set()),
    "mixing": (mixing.draw, {"pass_no", "block", "turn", "at"}),
    "urls": (lambda df: urls.judge(df, urls.RULES, "link"), {"host", "path", "rule", "verdict", "score"}),
    "fingerprints": (fingerprints.fingerprint, {"fingerprint"}),
}


@pytest.mark.parametrize("case", CASES)
def test_columns_keep_their_values(docs, case):
    run, made = CASES[case]
    out = run(docs)
    assert set(out.columns) == set(docs.columns) | made
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}-{r.row}" for n in NAMES if n not in made)
        assert r.doc_id == r.row % 5 and r.source == "s" + str(r.row % 2)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with_size = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, with_size, str(tmp_path))
        assert out.columns == with_size.columns, name
        assert all(r[n] == f"{n}-{r.row}" for r in out.collect() for n in NAMES), name
