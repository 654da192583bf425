"""Quality, mixing and toxicity recomputed in plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing, quality, toxicity


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_and_steps_of_positive_unlabelled_learning(prior):
    """Steps along numeric derivatives of the non-negative risk end where fit_pu ends."""
    data = np.random.default_rng(1)
    positive, unlabelled, hidden, rounds = data.normal(1, 1, (30, 2)), np.vstack([data.normal(1, 1, (20, 2)), data.normal(-1, 1, (40, 2))]), 2, 6
    got = quality.fit_pu(positive, unlabelled, prior, hidden=hidden, rounds=rounds, seed=3)
    rng = np.random.default_rng(3)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    prep = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = prep(positive), prep(unlabelled)
    w = np.concatenate([rng.normal(0, 3**-0.5, (3, hidden)).ravel(), np.zeros(hidden + 3)])

    def raw(w, a):
        h = np.tanh(a @ w[: 3 * hidden].reshape(3, hidden))
        return h @ w[3 * hidden : 4 * hidden] + a @ w[4 * hidden :]

    loss = lambda z: np.array([math.log1p(math.exp(-x)) for x in z])  # noqa: E731  of a score that should be high

    def risk(w, a, b):
        negative = loss(-raw(w, b)).mean() - prior * loss(-raw(w, a)).mean()
        # where the part of negatives is below zero, it alone is made to rise
        return prior * loss(raw(w, a)).mean() + negative if negative >= 0 else -negative

    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        g = np.array([(risk(w + e, a, b) - risk(w - e, a, b)) / 2e-6 for e in np.eye(len(w)) * 1e-6]) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.01 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.concatenate([got.hidden.ravel(), got.top]), w, atol=2e-3)
    assert np.allclose(got.score(both), 1 / (1 + np.exp(-raw(w, prep(both)))), atol=2e-3)


def test_prior_is_the_least_bounded_ratio_of_tails():
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 2000), rng.normal(-2, 1, 3000)])
    got = quality.estimate_prior(positive, unlabelled)
    margin = math.sqrt(math.log(20) / 6000) + math.sqrt(math.log(20) / 10000)
    best = min(((np.mean(unlabelled >= c) + margin) / np.mean(positive >= c), np.mean(unlabelled >= c) / np.mean(positive >= c)) for c in np.quantile(positive, np.linspace(0, 0.95, 96)))
    assert got == pytest.approx(best[1]) and abs(got - 0.4) < 0.05


def test_mixture_is_drawn_as_planned(spark, monkeypatch):
    """The exponent in closed form, then every pass document by document, up to where the budget ends."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    r = np.random.default_rng(4)
    sizes = {"a": 90, "b": 30, "c": 11, None: 20}
    rows = [(i, "w " * int(r.integers(0, 9)), s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((x.doc_id, x.pass_no) for x in mixing.draw(df, repeat=2.0, seed=7).collect())
    tokens = Counter()
    for _, text, s in rows:
        tokens[s] += len(text.split())
    every, high, low = sum(tokens.values()), max(tokens.values()), min(tokens.values())
    # no source may repeat more than twice: (low / high) ** (exponent - 1) = 2
    exponent = 1 - math.log(2) / math.log(high / low)
    power = {s: (n / every) ** exponent for s, n in tokens.items()}
    size = max(n * sum(power.values()) / power[s] for s, n in tokens.items())  # the least that leaves no source short of a pass
    key = F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"))
    counts = F.create_map(*[F.lit(x) for s, n in sizes.items() if s for x in (s, math.ceil(n / 7))])
    blocks = F.coalesce(F.try_element_at(counts, F.col("source")), F.lit(math.ceil(sizes[None] / 7)))
    keyed = df.withColumn("key", key).withColumn("block", F.pmod("key", blocks.cast("bigint")))
    ordered = {(k, x.doc_id): (x[f"o{k}"], x.block, x.key) for x in keyed.select("*", *[mixing._order(7, F.lit(k)).alias(f"o{k}") for k in (1, 2, 3)]).collect() for k in (1, 2, 3)}
    want = Counter()
    for s, n in tokens.items():
        passes = round(power[s] / sum(power.values()) * size / n, 9)
        own = [(i, len(t.split())) for i, t, source in rows if source == s]
        for k in range(1, int(passes) + 1):
            want.update((i, k) for i, _ in own)
        k, left = int(passes) + 1, (passes - int(passes)) * n
        if left > 0:
            for i, size_of in sorted(own, key=lambda x: ordered[(k, x[0])]):
                if size_of > left:
                    break
                left -= size_of
                want[(i, k)] += 1
    # documents of no words at the very end may go either way, and the last one of the source that comes to two passes but for the exponent's last digit
    odd = [rows[i] for (i, _), n in ((got - want) + (want - got)).items() if rows[i][1]]
    assert [s for _, _, s in odd] in ([], [min(tokens, key=tokens.get)]) and sum(n for (i, k), n in got.items() if k > 1) > 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


TERMS, STEMS = {"scumbag": 3.0, "vileperson": 2.5, "mud": 2.0}, {"grot": 4.0}


def plain_score(text, weights):
    edges = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‚‘’…–—¿¡"
    quotes = "\"“”„«»‚‘’'"

    def near(word):
        if any(word.startswith(s) for s in STEMS):
            return next(s for s in STEMS if word.startswith(s)), 0
        allowed = lambda t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
        found = sorted((distance(word, t), t) for t in TERMS if distance(word, t) <= allowed(t))
        return (found[0][1], found[0][0]) if found else None

    def classify(raw):
        word = raw.strip(edges)
        found = near(word) if word else None
        if found is None and word and not word.isalpha():
            letters = "".join(c for c in word.translate(str.maketrans("013457@$", "oieastas")) if c.isalpha())
            found = near(letters) if len(letters) > 3 else None
            return found and (found[0], found[1] + 1)
        return found

    words = text.lower().split()
    hits = [(i, *h) for i, w in enumerate(words) if (h := classify(w))]
    exact = fuzzy = quoted = best = 0.0
    for k, (i, term, edits) in enumerate(hits):
        left, right = words[max(0, i - 8) : i + 1], words[i : i + 9]
        marks = any(w[0] in quotes for w in left) and any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in quotes for w in right)
        around = [w.strip(edges) for w in left + right[1:]]
        report, address = any(w in toxicity.REPORTING for w in around), any(w in toxicity.ADDRESS for w in around)
        others = sum(abs(hits[j][0] - i) <= 8 for j in (k - 1, k + 1) if 0 <= j < len(hits))
        weight = {**TERMS, **STEMS}[term] * (1 + others / 2 + address / 2) / (1 + edits)
        if marks or (report and not address):
            quoted += weight
        elif edits:
            fuzzy += weight
        else:
            exact += weight
        best = max(best, weight * (0.25 if marks else 1))
    x = [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(best), math.log1p(100 * len(hits) / (len(words) + 20)), float(bool(hits))]
    return 1 / (1 + math.exp(-(weights[0] + sum(a * b for a, b in zip(weights[1:], x)))))


def test_scores_of_toxicity_word_by_word(spark):
    weights = [-2.0, 1.1, 0.8, -0.6, 0.5, 0.3, 0.4]
    model = toxicity.Model(TERMS, STEMS, weights)
    r = np.random.default_rng(5)
    parts = ["you", "are", "a", "scumbag", "scumbog!", "scmbag", "sc0mbag", "vileperson,", "vilepersn", "vlepersn", "mud", "muds", "grotesque", "grotty", '"scumbag"', "he", "said", "“mud”", "called", "the", "quiet", "house", "…", "4", "your", "scumbags", "vi1eper$on", "ende."]
    texts = [" ".join(r.choice(parts, int(r.integers(0, 40)))) for _ in range(300)] + ["", "scumbag " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(text, weights), abs=1e-9), text
