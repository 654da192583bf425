"""Quality classifier by positive-unlabelled learning.

A model over surface statistics of a text is fitted by minimising the
non-negative unbiased PU risk: with trusted positives P, unlabelled text U and
the class prior p,

    risk = p * mean_P loss(+) + max(0, mean_U loss(-) - p * mean_P loss(-)),

where a batch whose bracket is negative takes a gradient step the other way.
The prior is estimated from positives and unlabelled text alone: over scores of
a first model, the least ratio of the share of U to the share of P above a
threshold, with a margin for the sampling error of both.

It's fitted on at most ``POSITIVES`` and ``UNLABELLED`` rows (those with the
smallest hashes of their ids), on the driver; all documents are scored over
their whole text, in one pass with no shuffle.

Rows: a null text counts as empty, empty texts have a score like others;
repeated rows have equal scores; without positives or unlabelled rows every
score is the prior of one half; long texts are scored whole; a column named like the
score gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

POSITIVES = 4_000
UNLABELLED = 8_000
THRESHOLD = 0.7

# byte classes: lower, upper, digit, space, line end, sentence mark, symbol, other
_CLASS = np.full(256, 7, dtype=np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\r\n", 4), (".,;:!?'\"()-", 5), ("#$%&*+/<=>@[\\]^_`{|}~", 6)):
    _CLASS[np.frombuffer(_chars.encode(), dtype=np.uint8)] = _k
_WORDS = 8
FEATURES = 128 + 64 + _WORDS
#: Bytes taken at once.
_UNIT = 4 << 20


def _word_features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * _WORDS
    lines = text.split("\n")
    different = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), different / n, again / n, min(20.0, len(text) / n), len(set(lines)) / len(lines),
        min(5.0, np.log1p(len(lines))), different / n**0.8, min(8.0, np.log1p(n / len(lines))),
    ]


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text."""
    out = np.zeros((len(texts), FEATURES))
    i = 0
    while i < len(texts):
        j, size, raw = i, 0, []
        while j < len(texts) and (j == i or size < _UNIT):
            raw.append(texts[j].encode())
            size += len(raw[-1])
            j += 1
        sizes = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        doc = np.repeat(np.arange(j - i), sizes)
        low = np.minimum(data, 127)
        out[i:j, :128] = np.bincount(doc * 128 + low, minlength=128 * (j - i)).reshape(-1, 128)
        if len(data) > 1:
            kinds = _CLASS[data]
            same = doc[1:] == doc[:-1]
            code = doc[1:] * 64 + kinds[:-1] * 8 + kinds[1:]
            out[i:j, 128:192] = np.bincount(code[same], minlength=64 * (j - i)).reshape(-1, 64)
        out[i:j, :192] = np.sqrt(out[i:j, :192] / np.maximum(1, sizes)[:, None])
        out[i:j, 192:] = [_word_features(t) for t in texts[i:j]]
        i = j
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    top: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        a = np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])
        h = np.tanh(a @ self.hidden)
        return np.hstack([h, a]) @ self.top

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 800, seed: int = 6) -> Model:
    """Adam on the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    d = both.shape[1] + 1
    model = Model(mean, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden + d), prior)
    prep = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = prep(positive), prep(unlabelled)
    params = [model.hidden, model.top]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(a: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dtop = np.hstack([h, a]).T @ dz
        dh = np.outer(dz, model.top[:hidden]) * (1 - h * h)
        return [a.T @ dh, dtop]

    for t in range(1, rounds + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        ha, hb = np.tanh(a @ model.hidden), np.tanh(b @ model.hidden)
        za, zb = np.hstack([ha, a]) @ model.top, np.hstack([hb, b]) @ model.top
        as_negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        neg = [x - y for x, y in zip(back(b, hb, sig(zb) / len(b)), back(a, ha, prior * sig(za) / len(a)))]
        if as_negative >= 0:
            pos = back(a, ha, -prior * sig(-za) / len(a))
            grad = [x + y for x, y in zip(pos, neg)]
        else:
            grad = [-x for x in neg]
        for w, g, m, v in zip(params, grad, first, second):
            g = g + 1e-3 * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= 0.01 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores of held-out positives and unlabelled rows: the least bounded ratio of their tails."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    share_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    share_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    ok = share_p > 0
    at = np.argmin((share_u[ok] + margin) / share_p[ok])
    return float(np.clip(share_u[ok][at] / share_p[ok][at], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model | None:
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    if prior is None:
        half_p, half_u = len(positive) // 2, len(unlabelled) // 2
        first = fit_pu(positive[:half_p], unlabelled[:half_u], 0.5, rounds=400)
        prior = estimate_prior(first.raw(positive[half_p:]), first.raw(unlabelled[half_u:]))
    return fit_pu(positive, unlabelled, prior)


def sample(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most POSITIVES rows of docs that trusted names and of at most UNLABELLED rows of docs."""
    order = [F.xxhash64(F.lit(6), "doc_id"), "doc_id"]
    ids = docs.where("doc_id is not null").select("doc_id")
    chosen = trusted.where("doc_id is not null").select("doc_id").distinct().orderBy(*order).limit(POSITIVES).withColumn("kind", F.lit(1))
    rest = ids.orderBy(*order).limit(UNLABELLED).distinct().withColumn("kind", F.lit(0))
    wanted = common.cut(chosen.unionByName(rest))  # bounded by the two limits
    rows = docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(wanted), "doc_id").select("kind", "text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"kind": b["kind"].astype("int32"), "x": [r.astype("<f4").tobytes() for r in features(b["text"].tolist())]})

    got = rows.mapInPandas(measure, "kind int, x binary").toPandas()
    of = lambda k: np.array([np.frombuffer(x, dtype="<f4") for x in sorted(got["x"][got["kind"] == k])], dtype=np.float64).reshape(-1, FEATURES)
    shuffled = np.random.default_rng(0)
    return tuple(x[shuffled.permutation(len(x))] for x in (of(1), of(0)))  # type: ignore[return-value]


def score(docs: DataFrame, model: Model | None, name: str = "score", column: str = "text") -> DataFrame:
    """docs with a score from 0 to 1."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(features(batch.tolist())) if len(batch) else [], dtype="float64")

    return docs.withColumn(name, quality(common.text_of(column)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels of fold 2 aren't learned from."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    known = docs.where(common.crc_fold("doc_id", 4) != 2)
    trusted = labels.where((common.crc_fold("doc_id", 4) != 2) & (F.col("quality") == 1))
    model = fit(*sample(known, trusted))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
