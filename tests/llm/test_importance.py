"""Importance resampling against plain Python that spells every run of words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tesserae.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score string, number string, long_enough string, tie string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, n, buckets):
    words = WORD.findall(lowered(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, n, buckets)[1])
    for text in target:
        t.update(features(text, n, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        words, own = features(text, n, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(own), weight, score, words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = Counter()
    for i, r in enumerate(able):
        drawn[(r[:4], i + 1 if i < len(able) * percent // 100 else None)] += 1
    for r in rows:
        if r[4] < least:
            drawn[(r[:4], None)] += 1
    return drawn


def found(df):
    return Counter(((r.doc_id, r.n_features, r.weight, r.score), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3])
def test_runs_of_words(spark, n):
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 13}é" if k % 3 else f"Ü-{k % 5}, X" for k in range(i % 40))) for i in range(60)]
    docs += [(None, None), (None, "alone"), (7, docs[7][1]), (7, "OTHER text ÀÉ ß 中文 字 9a"), (61, ""), (62, "\x00\x01 !"), (63, "lang " * 3000), (64, "x" * 70_000), (65, "\U0001f600 emoji space")]
    target = ["w1é w2é w3é", None, "", "Ü 1 x w5é", "w1é w2é w3é"]
    rows = [(d, t, "a", "b", "c", "d") for d, t in docs]
    got = importance.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=30, least_words=5)
    assert found(got) == brute(docs, target, n, 97, 30, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resample(none, some).collect() == []
    assert found(importance.resample(some, none, n=2, buckets=50)) == brute([(1, "a b c")], [], 2, 50, 10, 20)


def test_crc_algebra():
    shifts = importance.Shifts()
    docs = [[b"a"], [], [b"one", b"two" * 50, "dreiü".encode(), b"x" * 5000, b"y"], [b"q"] * 9]
    doc, crc = importance.feature_crcs(docs, 5, shifts)
    want = sorted((i, zlib.crc32(b" ".join(d[a : a + k]))) for i, d in enumerate(docs) for k in range(1, 6) for a in range(len(d) - k + 1))
    assert sorted(zip(doc.tolist(), crc.tolist())) == want


def test_contract(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    docs = [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    target = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    got = importance.op13_importance_resampling(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in got.schema} == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert found(got) == brute(docs, target, 1, 10_000, 10, 20)
