"""The registered queries over the smallest tables: their columns, and their rows against plain Python."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(sql):
    return duckdb.sql(sql).fetchall()


@pytest.fixture(scope="module")
def documents():
    return {i: (t or "", s) for i, t, s in rows(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'")}


def run(spark, name, want):
    df = __spark_entry__.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in want} == want
    return df.collect()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_token_files(spark, documents):
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in run(spark, "op2_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})}
    for i in sorted(documents):
        ids = [*t.encode(documents[i][0], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(documents)


def test_packing(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op3_packing", {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    own, held = {}, {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, (text, _) in documents.items():
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_quality_and_toxicity(spark, documents):
    for name, n, held, least, label in (("op6_quality", 4, 2, 0.7, "quality"), ("op9_toxicity", 5, 0, 0.5, "toxic")):
        got = run(spark, name, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
        assert Counter(r.doc_id for r in got) == Counter(list(documents))
        assert all(r.held_out == (fold(r.doc_id, n) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)
        known = dict(rows(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'"))
        right = [r.predicted == known[r.doc_id] for r in got if r.held_out and r.doc_id in known]
        assert len(right) < 20 or np.mean(right) > 0.7


def test_mixing(spark, documents):
    got = run(spark, "op7_temperature_mixing", {"doc_id": "bigint", "source": "string", "pass_no": "int", "block": "bigint", "turn": "int", "at": "double", "tokens": "bigint"})
    drawn = Counter((r.doc_id, r.pass_no) for r in got)
    assert set(drawn.values()) == {1} and {r.doc_id for r in got} == set(documents)
    assert all(r.tokens == len(documents[r.doc_id][0].split()) and r.source == documents[r.doc_id][1] for r in got)
    share, mixed = Counter(), Counter()
    for text, s in documents.values():
        share[s] += len(text.split())
    for r in got:
        mixed[r.source] += r.tokens
    high = max(share, key=share.get)
    # no source is short of a whole pass, none above two; that weights follow one exponent is tested on a table of small documents
    assert all(share[s] <= mixed[s] <= 2.0 * share[s] + 1 for s in share) and mixed[high] == share[high]


def test_near_duplicates_and_lines(spark, documents):
    got = run(spark, "op8_near_duplicates", {"doc_id": "bigint", "class_id": "bigint"})
    assert {r.doc_id for r in got} == set(documents) and all(r.class_id <= r.doc_id for r in got)
    of = {r.doc_id: r.class_id for r in got}
    words = {i: tuple(t.lower().split()) for i, (t, _) in documents.items()}
    first = {}
    for i in sorted(words):
        assert of[i] == of[first.setdefault(words[i], i)]
    kept = run(spark, "op1_line_dedup", {"doc_id": "bigint", "n_lines": "int", "n_dropped": "int", "dropped": "array<int>", "text": "string"})
    seen = set()
    for r in sorted(kept, key=lambda r: r.doc_id):
        lines, gone = documents[r.doc_id][0].split("\n"), set(r.dropped)
        assert r.n_dropped == len(gone)
        if r.text is not None:
            assert r.n_lines == len(lines) and r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
            left = [" ".join(x.lower().split()) for x in r.text.split("\n") if x.strip()]
            assert len(left) == len(set(left)) and not seen & set(left)  # no form stays twice
            seen |= set(left)


def test_nearest(spark):
    got = run(spark, "op10_permutation_index", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    held = {i: np.array(v, dtype=np.float64) for i, v in rows(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'") if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(held))
    x, hits, n = np.array([held[i] for i in ids]), 0, 0
    for q in ids[ids % 20 == 0].tolist():
        s = (x * held[q]).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        hits, n = hits + len({r.vec_id for r in own} & set(best)), n + len(best)
    assert hits / n >= 0.9


def test_urls(spark):
    got = {r.page_id: r for r in run(spark, "op5_url_filter", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})}
    pages = rows(f"SELECT page_id, url FROM '{SF}/pages.parquet'")
    assert len(got) == len(pages)
    for i, url in pages:
        rest = (url or "").partition("://")[2]
        cut = lambda x, marks: x[: min([x.find(m) for m in marks if m in x], default=len(x))]
        host, tail = cut(rest, "/?#").lower(), rest[len(cut(rest, "/?#")) :]
        path = cut(tail, "?#")
        fits = [(h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0]) and got[i].verdict in ("allow", "block") and best[1] in (None, got[i].verdict)
