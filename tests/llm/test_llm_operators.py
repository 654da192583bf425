"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import ann, fingerprints, lines, links, mixing, neardup, packing, quality, sketches, token_files, toxicity, urls

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, one string, band string, node int, score string"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 9))) for _ in range(800)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def edited(text, k, seed=0):
    w, r = text.split(" "), np.random.default_rng(seed)
    for i in r.choice(len(w), k, replace=False):
        w[i] = "zz" + str(r.integers(10**6))
    return " ".join(w)


def rows(texts):
    return [(i, t, "en", "abc"[i % 3] if i % 7 else None, None if t is None else len(t), "x", "y", 1, "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    base = [prose(200, s) for s in range(6)]
    out = base + [base[0], base[0].upper(), edited(base[1], 4), edited(base[2], 60), None, "", "   ", "a", "!!!", "???", prose(30_000, 99)]
    return out + [prose(60, 50) + "\n" + prose(40, 51), prose(60, 52) + "\n" + edited(prose(40, 51), 1) + "\n\nx", prose(40, 51), "é\u00e9 <|endoftext|>  two   spaces\n\n"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    manifest = token_files.write(docs, f"file://{tmp_path}/ids", BPE, end_id=0)
    got = {r.doc_id: r for r in token_files.read(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*ids_of(t), 0]
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (start, len(ids), crc(ids))
        start += len(ids)
    some = token_files.read(manifest, wanted=[2, 13]).collect()
    assert sorted(r.doc_id for r in some) == [2, 13] and all(r.ids == got[r.doc_id].ids and r.start == got[r.doc_id].start for r in some)


def test_token_files_read_only_what_is_asked_and_notice_damage(tmp_path):
    path = tmp_path / "x.ids"
    with open(path, "wb") as f:
        w = token_files.ShardWriter(f)
        for d in range(8):
            w.add(d, np.arange(100_000, dtype="<u4") + d)
        w.close()
    with open(path, "rb") as f:
        r = token_files.ShardReader(f)
        assert [d for d, _, _ in r.read({3})] == [3] and r.frames_read == 1 < len(r.frames)
    raw = bytearray(path.read_bytes())
    raw[r.frames[1][0] + 60] ^= 1
    path.write_bytes(raw)
    with open(path, "rb") as f, pytest.raises(Exception):  # noqa: B017  zstandard or the crc notices
        list(token_files.ShardReader(f).read())


def test_token_files_of_nothing(spark, empty, tmp_path):
    assert token_files.read(token_files.write(empty, f"file://{tmp_path}/none", BPE, 0)).count() == 0


def test_packing_covers_every_id_once(docs, texts):
    pieces = packing.pack(docs, BPE).collect()
    seqs = {}
    for i, t in enumerate(texts):
        ids = [*ids_of(t), 1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in np.frombuffer(p.ids, dtype="<u4").tolist()] == ids
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in own)
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.WIDTH


def test_packing_repeats_and_nothing(spark, empty):
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    assert packing.pack(twice, BPE).count() == 3
    assert packing.pack(empty, BPE).count() == 0


def test_first_fit_decreasing_is_the_plain_algorithm():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 101, 300).tolist()
    room, plain = [], []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        at = next((b for b, f in enumerate(room) if f >= lengths[i]), None)
        if at is None:
            room.append(100)
            plain.append([])
            at = len(room) - 1
        room[at] -= lengths[i]
        plain[at].append(i)
    assert packing.first_fit_decreasing(lengths, 100) == plain
    bins = packing.pack_group(lengths, 100)
    assert sum(100 - sum(p[2] for p in b) for b in bins) < 100


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").casefold()).strip(" ")


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    n, forms = len(texts), {}
    for i in range(n):
        t, nxt = texts[i] or "", texts[(i - 1) % n] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[i].near_edited, got[i].near_next) == (float(canon(t) == canon(e)), float(canon(t) == canon(nxt)))
        forms.setdefault(got[i].fingerprint, set()).add(canon(t))
        forms.setdefault(got[i].edited_fingerprint, set()).add(canon(e))
    assert all(len(v) == 1 for v in forms.values()) and len(forms) == len({x for v in forms.values() for x in v})


def test_fingerprints_with_colliding_digests(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "digests", lambda form: F.struct((F.length(form) * 0).cast("long").alias("a"), F.lit(7).cast("long").alias("b")))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    pairs = [(i, j) for i in got for j in got]
    assert all((got[i] == got[j]) == (canon(texts[i]) == canon(texts[j])) for i, j in pairs)


def test_fingerprints_fold_case_in_full(spark):
    texts = ["straße", "STRASSE", "Straẞe", "ﬁsh FLAG", "Fish ﬂag", "λόγος", "ΛΌΓΟΣ", "λόγοσ", "İstanbul", "i̇stanbul", "istanbul", "ŉ", "ʼN", "ΐ", "ΐ"]
    df = spark.createDataFrame([(i, t, "f", "d", "x") for i, t in enumerate(texts)], "doc_id long, text string, _form string, _digest string, fingerprint string")
    got = fingerprints.fingerprint(df)
    assert got.columns == ["doc_id", "text", "_form", "_digest", "fingerprint"]
    of = {r.doc_id: r for r in got.collect()}
    assert all((of[i].fingerprint == of[j].fingerprint) == (canon(a) == canon(b)) for i, a in enumerate(texts) for j, b in enumerate(texts))
    assert all((r._form, r._digest) == ("f", "d") and r.fingerprint != "x" for r in of.values())


def test_fingerprints_of_nothing(empty):
    assert fingerprints.compare(empty).count() == 0


def test_url_rules_and_model(spark):
    urls_ = ["http://A.example.NET/en/x", "https://example.net/de/", "http://x.example.com/de/1", "http://y.org/fr/2?q", "http://org", None, "no scheme", "", "http://net?x", "a://b://c/d", "http://m.free.example.com/en/1"]
    many = [f"http://w{i}.site.net/de/{i}" for i in range(60)] + [f"http://good{i}.org/fr/{i}" for i in range(60)] + ["http://w1.site.net/de/1"] * 5
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls_ + many)], "page_id long, url string, score string")
    got = {r.page_id: r for r in urls.judge(df, urls.RULES).collect()}
    assert len(got) == len(urls_ + many)
    assert [got[i].host for i in range(11)] == ["a.example.net", "example.net", "x.example.com", "y.org", "org", "", "", "", "net", "b:", "m.free.example.com"]
    assert [got[i].path for i in range(5)] == ["/en/x", "/de/", "/de/1", "/fr/2", ""]
    assert [got[i].rule for i in range(9)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "block", "allow"]
    assert got[5].verdict == got[7].verdict == "allow" and got[5].score is None
    # the model against a plain one
    text = lambda u: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^.*?://", "", u))
    rejected = lambda r: r.verdict == "block"
    ruled = [r for r in got.values() if r.rule]
    held = {r.url for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(4)) == 0).alias("h")).where("h").collect()}
    counts = {True: Counter(), False: Counter()}
    pad = "\u0002" * 5
    for r in ruled:
        if r.url not in held:
            t = pad + text(r.url)
            counts[rejected(r)].update(t[i - 5 : i + 1] for i in range(5, len(t)))

    def p(gram):
        out = {}
        for side in (True, False):
            prob = 1 / 1024
            for order in range(6):
                tail, ctx = gram[5 - order :], Counter()
                for g, n in counts[side].items():
                    if g[5 - order : 5] == tail[:-1]:
                        ctx[g[5]] += n
                total, kinds = sum(ctx.values()), len(ctx)
                if total:
                    prob = (ctx[tail[-1]] + kinds * prob) / (total + kinds)
            out[side] = prob
        return np.log(out[True] / out[False])

    for i in (4, 6, 10, 20):
        t = pad + text(got[i].url)
        want = np.mean([p(t[j - 5 : j + 1]) for j in range(5, len(t))])
        assert abs(got[i].score - want) < 1e-9


def test_urls_differ_in_digits_and_scripts_and_long_ones_are_whole(spark):
    """Characters that a folded alphabet would confuse, a long URL, and columns whose names clash."""
    good = [(f"http://g{i}.org/fr/{'24680'[i % 5]}é{i % 3}", "x") for i in range(60)]
    bad = [(f"http://b{i}.net/{'13579'[i % 5]}ü{i % 3}", "x") for i in range(60)]
    asked = [("http://zz/é0é2é4", "x"), ("http://zz/ü1ü3ü5", "x"), ("http://zz/" + "ü1" * 20_000, "x"), (None, "x")]
    df = spark.createDataFrame([(i, u, s, s) for i, (u, s) in enumerate(good + bad + asked)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.judge(df, urls.RULES).collect()}
    assert len(got) == 124 and got[120].score < got[121].score < got[122].score and got[122].verdict == "block"
    assert got[123].verdict == "allow" and got[123].score is None and set(got[0].asDict()) == {"page_id", "url", "host", "path", "rule", "verdict", "score"}


def test_urls_of_nothing(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def test_levenshtein_automaton_is_edit_distance():
    terms, stems = ["idiot", "worthless", "scum", "clown"], ["lowei"]
    a = toxicity.LexiconAutomaton(terms, stems)

    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (c != e))
        return d[-1]

    r = np.random.default_rng(2)
    words = terms + ["idiott", "idot", "1diot", "worthles", "wortless", "wurthlesss", "scums", "clwn", "loweix", "lowe", "cat", ""]
    words += ["".join(r.choice(list("idotclwnscum"), r.integers(3, 8))) for _ in range(500)]
    for w in words:
        if w.startswith("lowei"):
            assert a.match(w) == ("lowei", 0)
            continue
        best = min(((distance(w, t), t) for t in terms if distance(w, t) <= a.allowed(t)), default=None)
        assert (a.match(w) is None) == (best is None) and (best is None or a.match(w)[1] == best[0]), w


def test_toxicity_learns_and_weighs_quotes(spark):
    r = np.random.default_rng(3)
    bad = [prose(40, 100 + i).split() for i in range(60)]
    for w in bad:
        w[int(r.integers(40))] = "zubblek"
        w[int(r.integers(40))] = "zubblek"
    rows_ = [(i, " ".join(w), 1) for i, w in enumerate(bad)] + [(100 + i, prose(40, 300 + i), 0) for i in range(200)] + [(900, None, None), (901, "", None), (902, prose(40, 7) + " zubblekk zubblok", None), (903, prose(40, 7), None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    labels = docs.where("toxic is not null").select("doc_id", "toxic")
    model = toxicity.fit(docs.drop("toxic"), labels)
    assert list(model.terms) == ["zubblek"]
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all(got[i] >= 0.5 for i in range(60)) and all(got[100 + i] < 0.5 for i in range(200))
    assert got[900] == got[901] < 0.5 and got[902] > got[903]
    s = toxicity.Scorer(model)
    plain, quoted = s.features("you zubblek there"), s.features('he said "zubblek" there')
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0]
    assert toxicity.fit(docs, labels.where("false")).terms == {}


def test_quality_from_positives_and_unlabelled(spark):
    junk = [" ".join(w.upper() + "!!" for w in prose(50, 500 + i).split()) for i in range(60)]
    good = [prose(50, 700 + i) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(good + junk + [None, "", prose(20_000, 1)])), "doc_id long, text string")
    trusted = docs.where("doc_id < 120").select("doc_id")
    model = quality.fit(*quality.sample(docs, trusted))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert 0.5 < model.prior < 0.98 and all(0 <= v <= 1 for v in got.values()) and got[260] == got[261]
    right = [got[i] >= 0.7 for i in range(120, 200)] + [got[i] < 0.7 for i in range(200, 260)]
    assert np.mean(right) > 0.95
    assert quality.score(docs, quality.fit(*quality.sample(docs, trusted.where("false")))).where("score <> 0.5").count() == 0


def multiset(t):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts, similar):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(docs, texts):
    def similar(a, b):
        x, y = multiset(a), multiset(b)
        both = sum((x & y).values())
        return both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) if x and y else (a or "") == (b or "") and not x and not y

    got = {r.doc_id: r.class_id for r in neardup.classify(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, similar)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_around_a_common_passage(spark):
    """Texts that share most of their words but aren't alike, and a pair among them that is."""
    passage = prose(150, 1)
    t = [passage + " " + prose(60, 10 + i) for i in range(60)]
    t[17] = edited(t[3], 2)
    got = {r.doc_id: r.class_id for r in neardup.classify(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 17 else i for i in range(60)}


@pytest.mark.parametrize("comparisons", [0, 1 << 20])
def test_apart_members_miss_no_link(spark, monkeypatch, comparisons):
    """All texts in one bucket, compared with its ends, then as they are bounded by parity maps, with and without rounds of pivots."""
    monkeypatch.setattr(links, "COMPARISONS", comparisons)
    base = [prose(80, s) for s in range(12)]
    t = base + [edited(b, k, 3) for b in base for k in (1, 2, 3, 5, 9)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "node long, text string")
    items = df.select("node", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("bands"))
    got = {r.node: r.root for r in links.classes(items, lambda wanted: df.join(wanted, "node"), neardup.elements(5), 0.8).collect()}

    def similar(a, b):
        x, y = multiset(a), multiset(b)
        both = sum((x & y).values())
        return both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)

    assert [got.get(i, i) for i in range(len(t))] == brute_classes(t, similar)


def test_parity_maps_bound_the_difference():
    r = np.random.default_rng(6)
    doc, e = neardup.elements(5)([prose(60, 1), prose(60, 2), edited(prose(60, 1), 3), ""])
    m = links.parity_maps(doc, e, 4)
    sets = [set(e[doc == i].tolist()) for i in range(4)]
    for i in range(4):
        for j in range(4):
            differ = sum(int(x).bit_count() for x in (m[i] ^ m[j]).view("<u8"))
            assert differ <= len(sets[i] ^ sets[j]) and (len(sets[i] ^ sets[j]) > 60 or differ >= 0.8 * len(sets[i] ^ sets[j]))
    texts_, a, b = [prose(30, s) for s in range(3)] + [edited(prose(30, 0), 1)], r.integers(0, 4, 50), r.integers(0, 4, 50)
    want = [len(sets_ & other) >= 0.5 * len(sets_ | other) for sets_, other in ((set(multiset(texts_[x])), set(multiset(texts_[y]))) for x, y in zip(a, b))]
    assert links.alike(texts_, a, b, neardup.elements(5), 0.5).tolist() == want


def test_near_duplicates_repeated_ids_and_nothing(spark, empty):
    df = spark.createDataFrame([(1, prose(50, 1)), (1, prose(50, 2)), (5, prose(50, 2)), (None, prose(50, 2)), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.classify(df).collect()) == [(1, 1), (5, 1)]
    # a text of its own stays, whatever other rows have its doc_id
    assert sorted((str(r.doc_id), r.text or "") for r in neardup.keep_one(df).collect()) == sorted([("1", prose(50, 1)), ("1", prose(50, 2)), ("None", prose(50, 2)), ("None", "")])
    assert neardup.classify(empty).count() == 0


def test_bag_minhash_is_unbiased():
    key = np.arange(1, 41, dtype=np.uint64)
    r = np.random.default_rng(4)
    a, b = r.integers(0, 6, 40), r.integers(0, 6, 40)
    doc = np.repeat([0, 1], 40)
    count = np.concatenate([a, b])
    keep = count > 0
    s = sketches.bag_minhash(doc[keep], sketches.mix(np.concatenate([key, key]))[keep], count[keep], 2, 1 << 14)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.02


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(101)} | {200 + i: 200 for i in range(50)} | {300: 300, 301: 300}
    assert got == want


def test_line_dedup(docs, texts):
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    flat, gone = [], {i: set() for i in range(len(texts))}
    for i, t in enumerate(texts):
        if t is not None:
            flat += [(i, n, f) for n, f in zip(*lines.forms(t, lines.MIN_CHARS))]
    sh = [{f[k : k + 8] for k in range(max(1, len(f) - 7))} for _, _, f in flat]
    root = brute_classes(range(len(flat)), lambda x, y: len(sh[x] & sh[y]) >= 0.8 * len(sh[x] | sh[y]))
    for k, r in enumerate(root):
        if r != k:
            gone[flat[k][0]].add(flat[k][1])
    for i, t in enumerate(texts):
        assert set(got[i].dropped) == gone[i]
        assert got[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]))


def test_line_dedup_has_no_least_length(spark):
    """Brute force over all lines with a visible character, without the operator's own forms()."""
    menus = ["Home", "home ", "ok", "Share on Facebook", "share  on facebook", "Share on Facebook!", "--------", "-------------", "---", "----", "é", "x", "", "  ", "All rights reserved 2024", "All rights reserved 2025", prose(12, 70)]
    texts = ["\n".join(np.random.default_rng(s).choice(menus, 7)) for s in range(25)]
    flat = [(i, n, " ".join(x.lower().split())) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.strip()]
    sh = [{f[k : k + 8] for k in range(max(1, len(f) - 7))} for _, _, f in flat]
    root = brute_classes(range(len(flat)), lambda x, y: len(sh[x] & sh[y]) >= 0.8 * len(sh[x] | sh[y]))
    gone = {i: {flat[k][1] for k, r in enumerate(root) if r != k and flat[k][0] == i} for i in range(len(texts))}
    got = {r.doc_id: set(r.dropped) for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == gone


def test_line_dedup_repeats_and_nothing(spark, empty):
    t = prose(30, 1) + "\n" + prose(30, 2)
    df = spark.createDataFrame([(1, t), (1, t), (2, prose(30, 2)), (None, prose(30, 1)), (None, None)], "doc_id long, text string")
    left = [x for r in lines.dedup(df).collect() for x in (r.text or "").split("\n") if x]
    assert sorted(left) == sorted(t.split("\n"))
    assert lines.dedup(empty).count() == 0


def test_line_dedup_keeps_unique_text_of_repeated_ids(spark):
    """Two texts under one doc_id and several under null: a row loses only lines that an earlier row has."""
    one, two, near = prose(30, 1), prose(30, 2), prose(30, 3)
    texts = [(1, f"{one}\nshort\n{two}"), (1, f"{prose(30, 4)}\nshort\n{prose(30, 5)}\n  "), (2, prose(30, 6)), (2, prose(30, 6)), (2, "short"), (None, f"{two}\n{prose(30, 7)}\n{near}"), (None, f"{prose(30, 8)}\n{two}\n{edited(near, 1)}"), (None, prose(30, 9)), (None, None)]
    held = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    flat = [(i, n, " ".join(x.lower().split())) for i, (_, t) in enumerate(held) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    sh = [{f[k : k + 8] for k in range(max(1, len(f) - 7))} for _, _, f in flat]
    root = brute_classes(range(len(flat)), lambda x, y: len(sh[x] & sh[y]) >= 0.8 * len(sh[x] | sh[y]))
    gone = {flat[k][:2] for k, r in enumerate(root) if r != k}
    want = [(d, t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, (d, t) in enumerate(held)]
    got = lines.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_permutation_index_recall_in_full_blocks(spark, monkeypatch):
    """Thousands of rows of one norm, in several blocks of rows and of queries, doubles; and the exact search."""
    monkeypatch.setattr(ann, "QUERIES", 100)
    r = np.random.default_rng(11)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    best = {q: set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, 6000, 20)}
    for rerank, least in ((ann.RERANK, 0.9), (1.0, 1.0)):
        hits = Counter(g.query_id for g in ann.search(df, df.where("vec_id % 20 = 0"), 20, rerank=rerank).collect() if g.id in best[g.query_id])
        assert sum(hits.values()) / (20 * len(best)) >= least


def test_mixing_meets_its_limits(spark, empty):
    rows_ = [(i, prose(20, i), "big") for i in range(900)] + [(1000 + i, prose(20, i), "mid") for i in range(200)] + [(2000 + i, prose(20, i), None) for i in range(30)] + [(3000, None, "none"), (3001, "", "big")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    drawn = mixing.draw(df, repeat=3.0)
    n = {r.source: r for r in drawn.groupBy("source").agg(F.countDistinct("doc_id").alias("d"), F.sum(mixing.tokens(F.col("text"))).alias("t"), F.max("pass_no").alias("p")).collect()}
    assert (n["big"].d, n["mid"].d, n[None].d, n["none"].d) == (901, 200, 30, 1)  # no document is lost
    assert n["big"].p == 1 and n[None].p <= 3
    assert abs(n[None].t / (30 * 20) - 3.0) < 0.1
    # weights realised: shares to the power of one exponent
    a = np.log(n["mid"].t / n["big"].t) / np.log(200 / 900)
    assert abs(np.log(n[None].t / n["big"].t) / np.log(30 / 900) - a) < 0.02
    flat = mixing.draw(df, repeat=None, entropy=1.05, budget=6000.0)
    t = {r.source: r.t for r in flat.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("t")).collect() if r.t}
    w = np.array(list(t.values())) / sum(t.values())
    assert abs(-(w * np.log(w)).sum() - 1.05) < 0.03 and abs(sum(t.values()) - 6000) < 200
    assert mixing.draw(empty).count() == 0


def test_mixing_permutes_blocks(spark, monkeypatch):
    """Each pass has its own order of blocks, the last one stops within one block, and every pass but that is whole."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    rows_ = [(i, prose(10, i), "big") for i in range(900)] + [(1000 + i, prose(10 + i % 7, i), "small") for i in range(190)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows_], "doc_id long, text string, source string, block int, at double")
    drawn = mixing.draw(df, repeat=2.5).collect()
    assert set(drawn[0].asDict()) == {"doc_id", "text", "source", "pass_no", "block", "turn", "at"}
    for source in ("big", "small"):
        own = sorted((r for r in drawn if r.source == source), key=lambda r: r.at)
        assert [(r.pass_no, r.turn) for r in own] == sorted((r.pass_no, r.turn) for r in own) and all(0 <= r.at <= 1 for r in own)
        orders = {p: {r.turn: r.block for r in own if r.pass_no == p} for p in {r.pass_no for r in own}}
        for p, turns in orders.items():
            assert len(set(turns.values())) == len(turns) and all(len({r.turn for r in own if r.pass_no == p and r.block == b}) == 1 for b in turns.values())
    small = [r for r in drawn if r.source == "small"]
    ids = {p: Counter(r.doc_id for r in small if r.pass_no == p) for p in (1, 2, 3)}
    assert ids[1] == ids[2] == Counter(range(1000, 1190)) and 0 < len(ids[3]) < 190
    first, second, last = ({r.turn: r.block for r in small if r.pass_no == p} for p in (1, 2, 3))
    assert first != second and sorted(first.values()) == sorted(second.values())
    # the last pass takes whole blocks in its order but for the one it ends in
    whole = {b: sum(1 for r in small if r.pass_no == 1 and r.block == b) for b in first.values()}
    part = Counter(r.block for r in small if r.pass_no == 3)
    cut = [b for b in part if part[b] < whole[b]]
    assert len(cut) <= 1 and all(last[t] == cut[0] for t in [max(last)] if cut)
    assert [last[t] for t in sorted(last)] != sorted(last.values())


def test_permutation_index_recall_and_odd_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(0, 20, 3000)] + 0.6 * r.normal(size=(3000, 16))) * np.exp(r.normal(0, 0.2, (3000, 1)))
    x = x.astype(np.float32)
    x[200:900] = x[200]  # a vector that is very common
    rows_ = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] + [1.0] * 15, 1), (5060, [float("inf")] + [1.0] * 15, 1), (5080, [None] + [1.0] * 15, 1), (5100, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows_ + odd, "vec_id long, embedding array<float>, label int")
    got = {}
    for g in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.id, g.score))
    assert len(got) == 150
    hit, d = 0, x.astype(np.float64)
    for q, found in got.items():
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (20 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), 20)
    assert [g.id for g in few.orderBy("rank").collect()] != [] and few.count() == 2
    assert ann.search(df.where("false"), df, 20).count() == 0
