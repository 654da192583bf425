"""Toxicity: lexicon terms and their misspellings, weighed by what stands around them.

1. The lexicon is learned from labelled documents: words, and stems (beginnings
   shared by several words), whose share of toxic documents is significantly
   higher than the corpus's.
2. A trie of the lexicon is intersected with a Levenshtein automaton: a state
   is a set of (trie node, edits so far), made deterministic as it's needed, so
   a word is matched in one pass whatever the size of the lexicon.  Terms of
   five letters and more may have one edit, of nine and more two; stems none.
3. Every hit has a window of words around it.  Quotation marks and reporting
   words speak for quotation; address and further hits speak for abuse.
4. A logistic model over the sums of these hit scores gives the document score.

The labelled rows that are learned from are at most ``LABELLED`` (those with the
smallest hash of their id); words of 3 to 40 characters can be terms, and every
significant one is.  All documents are scored over their whole text, however long, in
one pass with no shuffle.

Rows: null and empty texts have no hits and the score of such documents;
repeated rows have equal scores; without labels the lexicon is empty and all
scores are equal and below one half; a column named like the score gives way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LABELLED = 10_000
WINDOW = 8

_QUOTES = "\"“”„«»‚‘’'"
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‚‘’…–—¿¡"
_LEET = str.maketrans("013457@$", "oieastas")
#: Fixed word lists of the window scores.
REPORTING = frozenset("said says wrote called quoted quote reported word term sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre you're u ur du dich dein ihr euch tu te toi vous votre tú eres usted ustedes vosotros".split())


class LexiconAutomaton:
    """A lexicon trie times a Levenshtein automaton, determinised lazily."""

    #: Transitions kept before the table starts afresh.
    LIMIT = 100_000

    def __init__(self, terms: list[str], stems: list[str] = ()):  # type: ignore[assignment]
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most = [0]
        for word, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            edits = 0 if is_stem else self.allowed(word)
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            if is_stem:
                self.stem[node] = word
            else:
                self.term[node] = word
        self._reset()

    @staticmethod
    def allowed(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def _reset(self) -> None:
        self.states: dict = {}
        self.sets: list = []
        self.stems: list = []
        self.accepts: list = []
        self.moves: list[dict[str, int]] = []
        self.made = 0
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem: str | None) -> int:
        todo = list(nodes)
        while todo:  # letters that the word leaves out
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        stem = stem or next((self.stem[n] for n, e in nodes.items() if e == 0 and self.stem[n]), None)
        key = (frozenset(nodes.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.stems.append(stem)
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] and e <= self.allowed(self.term[n])]
            self.accepts.append(min(ends) if ends else None)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        return self._state(out, self.stems[state])

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits; a stem counts as no edits."""
        if self.made > self.LIMIT:
            self._reset()
        state = self.start
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
                self.made += 1
            state = nxt
            if not self.sets[state]:
                break
        else:
            if self.accepts[state] and not (self.stems[state] and self.accepts[state][0]):
                return self.accepts[state][1], self.accepts[state][0]
        return (self.stems[state], 0) if self.stems[state] else None


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-2.0] + [0.0] * FEATURES)


#: Exact, misspelled, quoted, hits in the best window, hits for the length, any hit.
FEATURES = 6


class Scorer:
    """Per Python worker: the automaton, and which words are known to be clean."""

    CLEAN = 150_000

    def __init__(self, model: Model):
        self.model = model
        self.weight = {**model.terms, **model.stems}
        self.automaton = LexiconAutomaton(list(model.terms), list(model.stems))
        self.clean: set[str] = set()
        self.bad: dict[str, tuple[str, int]] = {}

    def classify(self, raw: str) -> tuple[str, int] | None:
        word = raw.strip(_STRIP)
        found = self.automaton.match(word) if word else None
        if found is None and word and not word.isalpha():
            plain = "".join(c for c in word.translate(_LEET) if c.isalpha())
            found = self.automaton.match(plain) if len(plain) > 3 else None
            found = (found[0], found[1] + 1) if found else None
        return found

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, str, int]]]:
        words = text.lower().split()
        odd = set(words).difference(self.clean)
        found = {}
        for w in odd:
            hit = self.bad.get(w)
            if hit is None:
                hit = self.classify(w)
                if hit is None:
                    self.clean.add(w)
                    continue
                self.bad[w] = hit
            found[w] = hit
        if len(self.clean) > self.CLEAN:
            self.clean = set()
        if len(self.bad) > self.CLEAN:
            self.bad = {}
        return words, [(i, *found[w]) for i, w in enumerate(words) if w in found] if found else []

    def features(self, text: str) -> list[float]:
        words, hits = self.hits(text)
        exact = fuzzy = quoted = best = 0.0
        places = [h[0] for h in hits]
        for k, (i, term, edits) in enumerate(hits):
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            own = i - max(0, i - WINDOW)
            before, after = around[: own + 1], around[own:]
            marks = any(w[0] in _QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in tuple(_QUOTES) for w in after)
            report = any(w.strip(_STRIP) in REPORTING for w in around)
            near = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(places) and abs(places[j] - i) <= WINDOW)
            address = any(w.strip(_STRIP) in ADDRESS for w in around)
            weight = self.weight[term] * (1 + 0.5 * near + 0.5 * address) / (1 + edits)
            if marks or (report and not address):
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                exact += weight
            best = max(best, weight * (0.25 if marks else 1))
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(best), math.log1p(100 * len(hits) / (len(words) + 20)), float(bool(hits))]

    def score(self, features: list[float]) -> float:
        w = self.model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """text, toxic of at most that many labelled rows, chosen by a hash of their ids."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(most)
    texts = docs.where("doc_id is not null").select("doc_id", common.text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most `most` small rows


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems, with their log odds."""
    strip = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, strip, "")))
    rows = sample.select("toxic", F.explode(words).alias("word")).where("length(word) between 3 and 40")
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).head()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        return {}, {}
    base = toxic / n
    by_word = common.cut(rows.groupBy("word").agg(F.count("*").alias("all"), F.sum("toxic").alias("bad")))
    kinds = max(2, by_word.count())
    least = 2 * math.log(kinds) + 4
    share = F.col("bad") / F.col("all")
    clean = F.col("all") - F.col("bad")
    gain = 2 * (F.col("bad") * F.log(share / base) + F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0))
    good = (F.col("bad") >= 3) & (share >= 0.75)
    odds = F.log((F.col("bad") + 0.5) / (clean + 0.5)) - math.log(base / (1 - base))
    # a stem's documents are counted once for each of its words; many words make up for that
    stem = F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.length("word") - 1)), lambda k: F.substring("word", F.lit(1), k)))
    stems = by_word.where("length(word) >= 5").select(stem.alias("word"), "all", "bad").groupBy("word").agg(F.sum("all").alias("all"), F.sum("bad").alias("bad"), F.count("*").alias("kinds"))
    stems = stems.where((F.col("kinds") >= 5) & (F.col("bad") >= 8) & (share >= 0.95)).select("word", gain.alias("gain"), odds.alias("odds")).where(F.col("gain") > 1.5 * least)
    terms = by_word.where(good).select("word", gain.alias("gain"), odds.alias("odds")).where(F.col("gain") > least)
    found: dict[str, float] = {}
    for r in stems.orderBy(F.desc("gain"), F.desc(F.length("word")), "word").collect():
        if not any(r["word"].startswith(s) or s.startswith(r["word"]) for s in found):
            found[r["word"]] = r["odds"]
    best = terms.orderBy(F.desc("gain"), "word").collect()
    return {r["word"]: r["odds"] for r in best if not any(r["word"].startswith(s) for s in found)}, found


def _scorer(model: Model) -> Scorer:
    """One for each Python worker."""
    return common.worker_cache(("toxicity", repr(model)), lambda: Scorer(model))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, toxic; the caller leaves out the rows not to learn from."""
    sample = common.cut(labelled(docs, labels))
    terms, stems = learn_lexicon(sample)
    model = Model(terms, stems)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(model)
        for b in batches:
            yield pd.DataFrame({"x": [scorer.features(t) for t in b["text"]], "toxic": b["toxic"].astype("float64")})

    rows = sample.mapInPandas(measure, "x array<double>, toxic double").collect()  # LABELLED rows of FEATURES numbers
    if terms or stems:
        model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> list[float]:
    """Newton's method with a ridge; the intercept comes first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, name: str = "score", column: str = "text") -> DataFrame:
    """docs with a score from 0 to 1."""

    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(model)
        for batch in texts:
            yield pd.Series([scorer.score(scorer.features(t)) for t in batch], dtype="float64")

    return docs.withColumn(name, toxicity(common.text_of(column)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels of fold 0 aren't learned from."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(docs, labels.where(common.crc_fold("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
