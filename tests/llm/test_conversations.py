"""Repair against a search over all edits, and the whole query against plain Python."""

import hashlib
import re
import zlib
from itertools import product

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import conversations as c

GOOD = re.compile(r"(s?(ua)+)?")


def search(symbols):
    """Least (cost, edits) of all ways to edit a few rows, found by spelling them all."""
    best = None
    gaps = [""] + ["I", "II"]
    for between in product(gaps, repeat=len(symbols) + 1):
        for ops in product("KRD", repeat=len(symbols)):
            edits, cost, outs = "", 0, [""]
            for i in range(len(symbols) + 1):
                for _ in between[i]:
                    outs, cost = [o + x for o in outs for x in "ua"], cost + 5
                edits += between[i]
                if i == len(symbols):
                    break
                s, op = symbols[i], ops[i]
                edits += op
                if op == "D":
                    cost += 2
                    continue
                if s == "-":
                    cost += 1 << 30
                cost += (op == "R") + (5 if s.isupper() else 0)
                outs = [o + x for o in outs for x in ("ua" if op == "R" else s.lower())]
            if cost < 1 << 30 and any(GOOD.fullmatch(o) for o in outs) and (best is None or (cost, edits) < best):
                best = (cost, edits)
    return best


def solved(pieces):
    """Cost and edits of a conversation of these pieces, through the trie and the chain."""
    asked = sorted({(s, p) for i, p in enumerate(pieces) for s in ([c.E] if i == 0 else range(4))})
    known = {(s, p): layer for s, p, layer in c.walk(iter(asked))}
    ways = []
    for i, p in enumerate(pieces):
        own = []
        for s in [c.E] if i == 0 else range(4):
            layer = known[(s, p)]
            own += [{"start": s, "end": e, "cost": cost, "place": sum(x < edits for _, x in layer.values())} for e, (cost, edits) in layer.items()]
        ways.append(own)
    cost, way, tail = c.chain(ways)
    return cost, "".join(known[(s, p)][e][1] for p, (s, e) in zip(pieces, way)) + tail


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("suaxSUAX-"), max_size=4), st.integers(1, 3))
def test_trie_and_chain_find_the_least_edits(symbols, size):
    text = "".join(symbols)
    pieces = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    assert solved(pieces) == search(text)


@settings(max_examples=100, deadline=None)
@given(st.text("suaxSUAX-", max_size=40), st.integers(1, 9))
def test_pieces_dont_matter(text, size):
    assert solved([text[i : i + size] for i in range(0, len(text), size)] or [""]) == solved([text])


def plain(rows, ids):
    """rows: conv, turn, role, text after damage."""
    out = set()
    for conv in ids:
        own = sorted(((t, r, x) for v, t, r, x in rows if v == conv), key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(y[2].encode()).digest()[:16]))
        seen, faults, symbols = set(), "", ""
        for _, role, text in own:
            last = text.rstrip(c.WHITE)[-1:]
            fault = "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "."
            seen.add((role, text))
            faults += fault
            x = role[:1] if role[:1] and role[:1] in "sua" else "x"
            symbols += "-" if fault in "bd" else x.upper() if fault == "t" else x
        cost, audit = solved([symbols])
        at, state, done = 0, c.E, []
        for e in audit:
            if e == "I":
                state = c._MADE[state]
                done.append(("user" if state == c.U else "assistant", ""))
                continue
            _, role, text = own[at]
            at += 1
            if e != "D":
                state = c._MADE[state] if e == "R" else c._AFTER[(state, role[:1])]
                done.append((role if e == "K" else "user" if state == c.U else "assistant", text))
        assert GOOD.fullmatch("".join(r[:1] for r, _ in done))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.add((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()))
    return out


def damaged(rows):
    s = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


NASTY = (
    [(1, None, "user", "Hi."), (1, None, None, None), (1, 3, "assistant", "no end"), (1, 3, "assistant", "Other end."), (1, 9, "", "x."), (1, 2**40, "System", "Caps!")]
    + [(None, 0, "user", "A null id?"), (None, 1, "assistant", "Yes.")]
    + [(2, i, "user" if i % 2 else "assistant", f"turn {i}." if i % 7 else "cut off") for i in range(700)]  # over several pieces
    + [(3, 0, "user", "same.")] * 900  # one hot row
    + [(4, 0, "system", " "), (4, 1, "user", "é" * 50_000 + ".\n\x0b"), (5, 7, "user", ""), (6, 0, "assistant", "\r\n")]
)
EXTRA = "conv_id bigint, turn bigint, role string, text string, place string, digest string, kind string, piece string, fault string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_rows(spark):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in NASTY], EXTRA)
    got = c.repair(frame)
    shown = [(v, t, " " if r is None else r, " " if x is None else x) for v, t, r, x in NASTY]
    assert got.count() == len({r[0] for r in NASTY})
    assert rows_of(got) == plain(shown, {r[0] for r in NASTY})
    broken = c.repair(c.damage(frame), frame)
    assert rows_of(broken) == plain(damaged(NASTY), {r[0] for r in NASTY})


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert c.repair(none).collect() == []
    only = spark.createDataFrame([(8,)], "conv_id bigint")
    assert rows_of(c.repair(none, only)) == {(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = c.op12_conversation_repair(spark, sf)
    types = dict.fromkeys(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint") | {"audit": "string", "repaired_sha256": "string"}
    assert {f.name: f.dataType.simpleString() for f in got.schema} == types
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert rows_of(got) == plain(damaged(rows), {r[0] for r in rows})
