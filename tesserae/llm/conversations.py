"""Repair of conversation structure by dynamic programming over a trie of signatures.

A conversation's rows, by turn, have role initials and faults (blank, duplicate,
truncated).  The cheapest edits (``COSTS``) are wanted that leave role initials
``(s?(ua)+)?``; ties go to the edits whose initials D, I, K, R are ASCII-least.

A row is one symbol of a signature; what its text says besides doesn't matter.  Signatures
are cut into pieces of ``PIECE`` rows, equal pieces are solved once (grouped
before the shuffle), and pieces are sorted, so one with a prefix of another stands before it:
each task walks the prefix trie of its range depth first, keeps the layers of
the current path, computes the layers of new nodes only and emits answers at
terminal nodes.  A layer has, for each state that the output can be in, the least cost
and edits.  A piece is solved for each state that it can start in, and the pieces
of a conversation are chained from these answers (costs and the order of the edits
are enough), so a conversation of any length is no unit of work.

Rows of a conversation are numbered over ranges of (conversation, turn, role, digest of the text),
and the first of equal (role, text) is found by partial aggregation.  Only the digest
of the repaired text is a sequence by nature: one task reads a conversation's rows, in
order and in bounded memory (two bytes a row are held besides).

Rows: nulls are one space, null turns come first; rows of one turn are ordered by
role, then by digest of the text; repeated rows are duplicates; an empty role has no initial, so it is kept
nowhere; without rows a conversation is empty; columns of the input besides conv_id, turn, role
and text aren't read, so they can't clash; rows of a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import ranks

from . import common

#: Keep, re-role, delete, insert; an undeleted truncated row adds the last.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a piece: a power of two.
PIECE_BITS = 8
PIECE = 1 << PIECE_BITS
WHITE = " \t\n\x0b\x0c\r"

#: States of the output: nothing yet, after s, after u, after a.  What follows each letter; those that may end.
E, S, U, A = range(4)
_AFTER = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_MADE = {E: U, S: U, U: A, A: U}  # the state after an inserted or re-roled turn
_CLOSE = {E: (0, ""), S: (2 * INSERT, "II"), U: (INSERT, "I"), A: (0, "")}

Layer = dict[int, tuple[int, str]]


def step(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row.

    A symbol is a role initial (s, u, a, other ``x``), upper case if truncated, or ``-`` for a row that must go.
    Insertions stand before the row that they are inserted before, so equal edits are one string.
    """
    opened = dict(layer)
    for _ in range(3):  # insertions lead through at most three other states
        for state, (cost, edits) in list(opened.items()):
            better = (cost + INSERT, edits + "I")
            if better < opened.get(_MADE[state], (1 << 62, "")):
                opened[_MADE[state]] = better
    out: Layer = {}

    def offer(state: int, cost: int, edits: str) -> None:
        if state not in out or (cost, edits) < out[state]:
            out[state] = (cost, edits)

    more = TRUNCATED if symbol.isupper() else 0
    for state, (cost, edits) in opened.items():
        offer(state, cost + DELETE, edits + "D")
        if symbol != "-":
            kept = _AFTER.get((state, symbol.lower()))
            if kept is not None:
                offer(kept, cost + KEEP + more, edits + "K")
            offer(_MADE[state], cost + REROLE + more, edits + "R")
    return out


def walk(pieces: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, Layer]]:
    """pieces: (start state, signature), sorted.  Their last layers.

    The path holds the nodes from the trie's root to the last signature's terminal node; what two signatures share stays on it.
    """
    path: list[Layer] = []
    last: tuple[int, str] | None = None
    for start, signature in pieces:
        shared = 0
        if last is not None and last[0] == start:
            limit = min(len(signature), len(last[1]))
            while shared < limit and signature[shared] == last[1][shared]:
                shared += 1
            del path[shared + 1 :]
        else:
            path = [{start: (0, "")}]
        for symbol in signature[shared:]:
            path.append(step(path[-1], symbol))
        last = (start, signature)
        yield start, signature, path[-1]


_ANSWER = "start int, signature string, ends array<struct<state:int,cost:bigint,edits:string>>"


def solve(pieces: DataFrame) -> DataFrame:
    """pieces: start, signature, all different.  The least cost and edits for each state that a piece can end in."""
    n = common.partitions(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, str]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        held: list[tuple[int, str, list[dict]]] = []
        for start, signature, layer in walk(rows()):
            held.append((start, signature, [{"state": s, "cost": c, "edits": e} for s, (c, e) in sorted(layer.items())]))
            if len(held) == 1024:
                yield _answers(held)
                held = []
        if held:
            yield _answers(held)

    dealt = pieces.repartitionByRange(n, "start", "signature").sortWithinPartitions("start", "signature")
    return dealt.mapInArrow(run, _ANSWER)


def _answers(held: list[tuple[int, str, list[dict]]]) -> pa.RecordBatch:
    ends = pa.list_(pa.struct([("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
    start, signature, answers = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(start, pa.int32()), pa.array(signature), pa.array(answers, ends)], names=["start", "signature", "ends"])


def chain(pieces: list[list[dict]]) -> tuple[int, list[tuple[int, int]], str]:
    """pieces: of each piece, in order, what leads from start to end (start, end, cost, place in the order of edits).

    The least cost, (start, end) of each piece and what is inserted at last.  Least costs from the end backwards, then the least edits forwards:
    of two answers with the same start neither's edits begin with the other's, so the first difference decides.
    """
    left = [{s: c for s, (c, _) in _CLOSE.items()}]
    for piece in reversed(pieces):
        after: dict[int, int] = {}
        for x in piece:
            if x["end"] in left[-1]:
                after[x["start"]] = min(after.get(x["start"], 1 << 62), x["cost"] + left[-1][x["end"]])
        left.append(after)
    left.reverse()
    state, way = E, []
    for i, piece in enumerate(pieces):
        good = [x for x in piece if x["start"] == state and x["end"] in left[i + 1] and x["cost"] + left[i + 1][x["end"]] == left[i][state]]
        best = min(good, key=lambda x: x["place"])
        way.append((state, best["end"]))
        state = best["end"]
    return left[0][E], way, _CLOSE[state][1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that crc32 of ``conv_id:turn`` decides; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    dealt = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    dealt = dealt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return dealt.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "_")


def _cleared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and a digest of the text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text")).withColumn("digest", F.unhex(F.left(F.sha2("text", 256), F.lit(32))))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, piece (ascending in a conversation), signature, faults (b, d, t or . for each row)."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    own = F.when(last == "", "b").when(last.isin(".", "!", "?"), ".").otherwise("t")
    narrow = rows.select("conv_id", "turn", "role", "digest", own.alias("fault"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    numbered = ranks.numbered(narrow, order, "place")
    first = numbered.where("fault <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = numbered.join(first, "place", "left").withColumn("fault", F.when((F.col("fault") == "b") | F.col("first"), F.col("fault")).otherwise("d"))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("b", "d"), "-").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    piece = F.shiftright(F.col("place") - 1, PIECE_BITS)
    held = marked.groupBy("conv_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", symbol.alias("symbol"), "fault"))).alias("held"))  # PIECE rows at most
    text = lambda f: F.array_join(F.transform("held", lambda x: x[f]), "")
    return held.select("conv_id", "piece", text("symbol").alias("signature"), text("fault").alias("faults"))


def edits(pieces: DataFrame) -> DataFrame:
    """pieces with the edits of each, and of the last piece of a conversation what is inserted after it; cost of the conversation."""
    spark = pieces.sparkSession
    heads = pieces.groupBy("conv_id").agg(F.min("piece").alias("piece"))
    begun = pieces.join(heads.withColumn("head", F.lit(True)).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (pieces["piece"] == heads["piece"]), "left").drop("c", heads["piece"])
    # a conversation's first piece starts with nothing, others in any state
    starts = F.when(F.col("head"), F.array(F.lit(E))).otherwise(F.array(*[F.lit(s) for s in (E, S, U, A)]))
    asked = begun.select("conv_id", "piece", "signature", F.explode(starts).alias("start"))
    answers = common.stored(solve(asked.select("start", "signature").distinct()), "answers")
    known = asked.join(common.sized(answers), ["start", "signature"])
    place = lambda e: F.size(F.filter("ends", lambda x: x["edits"] < e))
    ways = known.select("conv_id", "piece", F.transform("ends", lambda x: F.struct(F.col("start"), x["state"].alias("end"), x["cost"].alias("cost"), place(x["edits"]).alias("place"))).alias("ways"))
    ways = ways.groupBy("conv_id", "piece").agg(F.flatten(F.collect_list("ways")).alias("ways"))
    linked = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ways"))).alias("pieces"))  # sixteen numbers at most for PIECE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cost, way, tail = chain([p["ways"] for p in held])
                for i, (p, (start, end)) in enumerate(zip(held, way)):
                    out.append((conv, p["piece"], start, end, cost, tail if i == len(held) - 1 else ""))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["conv_id", "piece", "start", "end", "cost", "tail"])

    chosen = linked.mapInArrow(run, "conv_id bigint, piece bigint, start int, end int, cost bigint, tail string")
    both = chosen.withColumnRenamed("conv_id", "c").join(pieces, F.col("c").eqNullSafe(F.col("conv_id")) & (chosen["piece"] == pieces["piece"])).drop("c", chosen["piece"])
    own = F.filter("ends", lambda x: x["state"] == F.col("end"))[0]["edits"]
    return both.join(common.sized(answers), ["start", "signature"]).select("conv_id", "piece", "faults", "cost", F.concat(own, "tail").alias("edits"))


_REPAIRED = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repair:
    """One conversation as its records come by: pieces first (edits, faults), then rows in order."""

    def __init__(self, conv: int | None):
        self.conv, self.cost, self.audit, self.faults = conv, 0, [], []
        self.hash, self.any = hashlib.sha256(), False
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.before, self.illegal, self.state = None, 0, E
        self.at, self.todo = 0, ""

    def piece(self, cost: int, edits_: str, faults: str) -> None:
        self.cost = cost
        self.audit.append(edits_)
        self.faults.append(faults)

    def turn_out(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any, self.state = True, state

    def insert(self) -> None:
        state = _MADE[self.state]
        self.turn_out("user" if state == U else "assistant", "", state)

    def row(self, turn: int | None, role: str, text: str) -> None:
        if not self.at:
            self.todo = "".join(self.audit)
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        while self.todo[self.at] == "I":
            self.insert()
            self.at += 1
        edit = self.todo[self.at]
        self.at += 1
        if edit == "K":
            self.turn_out(role, text, _AFTER[(self.state, role[:1])])
        elif edit == "R":
            state = _MADE[self.state]
            self.turn_out("user" if state == U else "assistant", text, state)

    def done(self) -> tuple:
        while self.at < len(self.todo):
            self.insert()
            self.at += 1
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        counted = [sum(f.count(x) for f in self.faults) for x in "bdt"]
        return (self.conv, gaps, *counted, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of rows (and of conversations: conv_id): its faults, the cheapest edits and the digest of what they make."""
    common.bound_batches(rows.sparkSession)
    clear = _cleared(rows)
    pieces = common.stored(signatures(clear), "pieces")
    solved = edits(pieces)
    every = (rows if conversations is None else conversations).select("conv_id").distinct()
    none = F.lit(None)
    stream = (
        every.select("conv_id", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), none.cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("number"))
        .unionByName(solved.select("conv_id", F.lit(1).alias("kind"), F.col("piece").alias("turn"), F.col("edits").alias("role"), F.col("faults").alias("text"), none.cast("binary").alias("digest"), F.col("cost").alias("number")))
        .unionByName(clear.select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "digest", F.lit(0).cast("bigint").alias("number")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Repair | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, kind, turn, role, text, number in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if kind == 0:
                    if current is not None:
                        out.append(current.done())
                    current = Repair(conv)
                elif kind == 1:
                    current.piece(number, role, text)
                else:
                    current.row(turn, role, text)
            if out:
                yield _rows(out)
        if current is not None:
            yield _rows([current.done()])

    sorted_ = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), F.when(F.col("kind") == 2, F.col("role")), "digest")
    return sorted_.select("conv_id", "kind", "turn", "role", "text", "number").mapInArrow(run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED)], schema=_REPAIRED)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair all conversations."""
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return repair(damage(rows), rows)


SQL = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
kinds AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 20 AS kind FROM given, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(sha256(text), 32)) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS x FROM damaged),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS x_before FROM placed),
opened(a, b, c, e) AS (VALUES ('E', 'E', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('E', 'U', 5, 'I'), ('E', 'A', 10, 'II'), ('S', 'U', 5, 'I'), ('S', 'A', 10, 'II'), ('U', 'A', 5, 'I'), ('A', 'U', 5, 'I')),
edited(b, op, x, d, c, go) AS (
  VALUES ('E', 'D', NULL, 'E', 2, true), ('S', 'D', NULL, 'S', 2, true), ('U', 'D', NULL, 'U', 2, true), ('A', 'D', NULL, 'A', 2, true),
    ('E', 'R', NULL, 'U', 1, false), ('S', 'R', NULL, 'U', 1, false), ('U', 'R', NULL, 'A', 1, false), ('A', 'R', NULL, 'U', 1, false),
    ('E', 'K', 's', 'S', 0, false), ('E', 'K', 'u', 'U', 0, false), ('S', 'K', 'u', 'U', 0, false), ('U', 'K', 'a', 'A', 0, false), ('A', 'K', 'u', 'U', 0, false)),
moves AS (SELECT o.a, m.d, m.x, m.go, o.c + m.c AS c, o.e || m.op AS e FROM opened o JOIN edited m USING (b)),
best(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'E', lpad('0', 12, '0') FROM faults
  UNION ALL
  SELECT r.conv_id, r.i, m.d, min(lpad(CAST(CAST(left(p.best, 12) AS BIGINT) + m.c + CASE WHEN r.fault = 't' AND NOT m.go THEN 5 ELSE 0 END AS VARCHAR), 12, '0') || substr(p.best, 13) || m.e)
  FROM best p JOIN faults r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1 JOIN moves m ON m.a = p.state AND (m.go OR r.fault NOT IN ('b', 'd')) AND (m.x IS NULL OR m.x = r.x)
  GROUP BY 1, 2, 3),
ends AS (
  SELECT conv_id, min(lpad(CAST(CAST(left(best, 12) AS BIGINT) + CASE state WHEN 'S' THEN 10 WHEN 'U' THEN 5 ELSE 0 END AS VARCHAR), 12, '0') || substr(best, 13) || CASE state WHEN 'S' THEN 'II' WHEN 'U' THEN 'I' ELSE '' END) AS best
  FROM best JOIN (SELECT conv_id AS c, max(i) AS n FROM faults GROUP BY 1) ON conv_id IS NOT DISTINCT FROM c AND i = n GROUP BY 1),
letters AS (
  SELECT conv_id, k, substr(substr(best, 13), CAST(k AS INTEGER), 1) AS op FROM ends, range(1, length(best) - 11) AS t(k)),
at_rows AS (SELECT *, sum(CASE WHEN op = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS j FROM letters),
made AS (
  SELECT l.conv_id, l.k, l.op, r.role, r.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS m,
    first_value(CASE WHEN l.op = 'K' AND r.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.k) AS system
  FROM at_rows l LEFT JOIN faults r ON l.op <> 'I' AND l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.j = r.i WHERE l.op <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (m - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM made GROUP BY 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (x_before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(best, 12) AS BIGINT), 0) AS cost, coalesce(substr(best, 13), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON c.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN ends ON c.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN repaired ON c.conv_id IS NOT DISTINCT FROM repaired.conv_id
"""
