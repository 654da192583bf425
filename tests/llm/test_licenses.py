"""License scan against every rule tried everywhere, and suppression pair by pair."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.rules()


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    own = words(text)
    return sorted((i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p)


def brute_detections(text):
    own = words(text)
    joined = " ".join(own)
    found = [(m.start(), m.end(), i) for i, r in enumerate(RULES) for m in r.pattern.finditer(joined)]

    def within(a, b):
        (s, e, i), (s2, e2, j) = a, b
        if RULES[j].rank > RULES[i].rank or not (s2 <= s and e <= e2):
            return False
        return (s2, e2) != (s, e) or j < i

    kept = [d for d in found if not any(within(d, other) for other in found if other != d)]
    place = lambda c: joined.count(" ", 0, c)
    return sorted((place(s), place(e - 1), RULES[i].name) for s, e, i in kept)


PARTS = st.sampled_from([
    "Under the MIT License", "under", "the", "mit", "license", "Apache License, Version 2.0", "apache", "CC BY-NC 4.0", "cc by", "nc", "sa", "GNU General Public License", "version 3", "v2", "or later",
    "SPDX-License-Identifier: GPL-2.0-or-later", "spdx license identifier", "licensed under the", "released under the terms of the", "GPLv3", "lgpl 2.1", "Creative Commons Attribution", "NonCommercial", "no derivatives",
    "all rights reserved", "public domain", "released into the", "mozilla public license 2.0", "copyright", "\n * ", "Straße", "中", "boost", "business source license", "https://creativecommons.org/licenses/by-nc/4.0", "bsd", "3-clause",
])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_scan_is_brute_force(parts):
    text = " ".join(parts)
    n, base, found = licenses.scan_text(text, licenses.Scanner(RULES))
    assert n == len(words(text))
    assert sorted((b["word"], b["label"]) for b in base) == brute_base(text)
    assert sorted((d["first"], d["last"], d["rule"]) for d in found) == brute_detections(text)


def test_rules_and_labels(spark):
    assert len(RULES) > 300 and [r.rank for r in RULES] == sorted(r.rank for r in RULES)
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2", "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "Mit der Lizenz zum Töten, mit Abstand.": "",
        "The general public has a license to drive; the art of it is free.": "", "cc by nc sa": "cc-by-nc,cc-by-nc-sa", "licensed under the LGPL 2.1 and GPLv2": "gpl-2,lgpl-2.1",
    }
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(cases)]
    got = licenses.labelled(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, labels string, base string, detections string"))).collect()
    assert {r.doc_id: r.labels for r in got} == dict(enumerate(cases.values()))
    assert all((r.score > 0.5) == (r.labels != "") for r in got)


def test_rows(spark):
    long = "filler words " * 40_000 + "under the mit license " * 3
    rows = [(1, None), (1, ""), (None, "cc by nc"), (2, long), (2, long), (3, "\x00 ... "), (4, "under the mit license cc by nc under the mit license")]
    got = licenses.labelled(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    by = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got if r.n_words < 100 and r.doc_id != 1)
    assert by == [(0, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc"), (3, 0, 0, None, None, "", ""), (4, 11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit")]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in got if r.n_words > 100] == [(80_012, 3, 80_000, 80_008)] * 2
    assert [(r.n_words, r.n_base, r.labels, r.score) for r in got if r.doc_id == 1] == [(0, 0, "", 0.0)] * 2
    assert licenses.labelled(licenses.scan(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []


def test_contract(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = licenses.op11_license_scan(spark, sf)
    types = {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    assert {f.name: f.dataType.simpleString() for f in got.schema if f.name in types} == types
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        labels = {x for _, x in base} | {name.split("/")[0] for *_, name in brute_detections(texts[r.doc_id])}
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words(texts[r.doc_id])), len(base), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert 0 <= r.score <= 1
