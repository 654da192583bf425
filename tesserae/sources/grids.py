"""Tables of filed documents, laid out on a grid: every cell has its rows and columns, spans included.

Python splits a document into cells, since which column a cell is in depends on the
spans of all cells before it, and gives each row with its label and the headings of its cells; all that
follows (units and scope by the words before a table, blocks, numbers) is a plan over the rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions.columns import parse_number
from tesserae.sources.parsers import UNITS

_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)([^>]*)>")
_SPAN = {"row": re.compile(r"rowspan\s*=\s*[\"']?(\d+)", re.I), "col": re.compile(r"colspan\s*=\s*[\"']?(\d+)", re.I)}
_CELLS = {"td": False, "th": True, "te": False, "tu": False}
#: What HTML allows: a span beyond it counts as this one.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534

Cell = tuple[int, int, int, int, bool, str]  # row, column, rows, columns, head, text


def _text(raw: str) -> str:
    if "<" in raw:
        raw = re.sub(r"<[^>]*>", " ", raw)
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def layout(rows: list[list[tuple[int, int, bool, str]]]) -> list[Cell]:
    """rows: cells as (rowspan, colspan, head, text).  Each cell's place; a cell takes the first columns that cells from above leave free."""
    taken: dict[int, int] = {}  # column: rows that it is still taken for
    out = []
    for r, row in enumerate(rows):
        at = 0
        begun: dict[int, int] = {}
        for down, wide, head, text in row:
            while taken.get(at, 0) > 0:
                at += 1
            down = min(down or len(rows) - r, len(rows) - r)  # 0: to the end of the table
            for c in range(at, at + wide):
                begun[c] = down
            out.append((r, at, down, wide, head, text))
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for c, n in begun.items():
            if n > 1:
                taken[c] = max(n - 1, taken.get(c, 0))
    return out


def tables(document: str) -> Iterator[tuple[str, list[Cell]]]:
    """(words since the table before, cells) of each table; a table inside a cell is one of its own, and not part of the cell's text."""
    last, said = 0, []
    stack: list[dict] = []

    def close_cell(t: dict) -> None:
        if t["cell"] is not None:
            t["rows"][-1].append((*t["cell"], _text("".join(t["text"]))))
            t["cell"] = None

    for m in _TAG.finditer(document):
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        between = document[last : m.start()]
        last = m.end()
        if stack and stack[-1]["cell"] is not None:
            stack[-1]["text"].append(between)
        elif not stack:
            said.append(between)
        if name == "table" and not closing:
            if stack and stack[-1]["cell"] is not None:
                stack[-1]["text"].append(" ")
            stack.append({"rows": [], "cell": None, "text": [], "before": _text(" ".join(said))})
            said = []
        elif name == "table" and stack:
            t = stack.pop()
            close_cell(t)
            yield t["before"], layout(t["rows"])
        elif stack and name == "tr":
            close_cell(stack[-1])
            if not closing:
                stack[-1]["rows"].append([])
        elif stack and name in _CELLS:
            t = stack[-1]
            close_cell(t)
            if not closing:
                if not t["rows"]:
                    t["rows"].append([])
                span = {k: int(found[1]) if attributes and (found := p.search(attributes)) else 1 for k, p in _SPAN.items()}
                t["cell"], t["text"] = (min(span["row"], MOST_ROWS), min(max(span["col"], 1), MOST_COLUMNS), _CELLS[name]), []
        elif stack and stack[-1]["cell"] is not None:
            stack[-1]["text"].append(" ")
        elif not stack:
            said.append(" ")


_ROWS = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("before", pa.string()), ("row", pa.int32()), ("label", pa.string()), ("parts", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
ROWS = "doc bigint, n int, before string, row int, label string, parts array<string>, texts array<string>"
#: Rows and cells of a batch, at most (a row is never cut).
BATCH_ROWS, BATCH_CELLS = 8192, 65_536


def labelled(cells: list[Cell]) -> Iterator[tuple[int, str, list[str], list[str]]]:
    """row, label (its first cell), the heading of each other cell (the lowest one of its columns that says anything) and the cell; cells without a heading are left out."""
    heads, rows = {}, {}
    for r, c, _, wide, head, text in cells:  # in the order of rows
        if not head:
            rows.setdefault(r, []).append((c, text))
        elif text:
            heads.update(dict.fromkeys(range(c, c + wide), text))
    for r, own in rows.items():
        if own[0][0] == 0:
            there = [(heads[c], text) for c, text in own[1:] if c in heads]
            yield r, own[0][1], [h for h, _ in there], [t for _, t in there]


def table_rows(documents: DataFrame) -> DataFrame:
    """documents: doc, body.  A row for each row that has a label of each table (n, from 0); a null body has none.  A document is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (before, cells) in enumerate(tables(body or "")):
                    for row in labelled(cells):
                        out.append((doc, n, before, *row))
                        held += len(row[-1])
                        if len(out) >= BATCH_ROWS or held >= BATCH_CELLS:
                            yield batch_of(out)
                            out, held = [], 0
            if out:
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return documents.select(F.col("doc").cast("bigint"), "body").mapInArrow(run, ROWS)


def unit_of(before: Column) -> Column:
    """The factor of the unit that the words before a table name last, else one."""
    words = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
    named = F.regexp_extract_all(F.lower(before), F.lit(rf"(?:단위|in|unit)\s*[:：]?\s*({words})"), F.lit(1))
    factors = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(factors, F.try_element_at(named, F.lit(-1))), F.lit(1.0))


#: Words of titles, of rows that open and close a period, and of columns that hold the whole.
CONSOLIDATED, TITLE = "연결", "자본변동표"
OPENING, CLOSING = "기초(?:자본)?", "(?:분기말|반기말|기말)(?:자본)?"
WHOLE = ("자본총계", "자본합계", "자본 합계", "자본 총계")


def equity_changes(documents: DataFrame) -> DataFrame:
    """documents: doc, body.  Changes in equity: doc, scope, ends (date), step (number of the row in its period), label, part, amount.

    Tables count whose words before them name the statement.  The part of a column is the lowest
    heading above it that says anything; a row's label is its first cell.  A period begins at a row
    'YYYY.MM.DD (opening)' and ends at the next closing row, whose date it has; rows outside periods and cells without a number are left out.
    """
    rows = table_rows(documents).where(F.contains("before", F.lit(TITLE)))
    title = F.regexp_extract("before", rf"((?:{CONSOLIDATED}\s*)?{TITLE})(?!.*{TITLE})", 1)
    scope = F.when(title.startswith(CONSOLIDATED), "consolidated").otherwise("separate")
    key = ["doc", "n"]
    date = F.regexp_extract("label", rf"(\d{{4}}\.\d{{2}}\.\d{{2}})\s*\(?\s*(?:{OPENING}|{CLOSING})", 1)
    opens, closes = F.col("label").rlike(rf"\(?\s*{OPENING}\s*\)?$"), F.col("label").rlike(rf"\(?\s*{CLOSING}\s*\)?$")
    marked = rows.select(*key, scope.alias("scope"), unit_of(F.col("before")).alias("unit"), "row", "label", "parts", "texts", date.alias("date")).withColumns({"opens": (F.col("date") != "") & opens, "closes": (F.col("date") != "") & closes})
    # the windows share one exchange by table, of rows and not of cells
    order = Window.partitionBy(*key).orderBy("row")  # the rows of one table
    numbered = marked.withColumn("period", F.sum(F.col("opens").cast("int")).over(order))
    inside = Window.partitionBy(*key, "period")
    numbered = numbered.where("period > 0").withColumn("end_row", F.min(F.when(F.col("closes"), F.col("row"))).over(inside)).withColumn("ends", F.min_by("date", F.when(F.col("closes"), F.col("row"))).over(inside))
    numbered = numbered.where(F.col("row") <= F.col("end_row")).withColumn("step", F.row_number().over(inside.orderBy("row")) - 1)
    kind = F.when(F.col("opens"), "opening").when(F.col("closes"), "closing").otherwise(F.col("label"))
    values = numbered.select("doc", "scope", "unit", F.to_date("ends", "yyyy.MM.dd").alias("ends"), "step", kind.alias("label"), F.inline(F.arrays_zip(F.col("parts").alias("part"), F.col("texts").alias("text"))))
    part = F.when(F.col("part").isin(*WHOLE), "whole").otherwise(F.regexp_replace("part", r"\s*합계$", ""))
    amount = parse_number(F.col("text")) * F.col("unit")
    return values.select("doc", "scope", "ends", "step", "label", part.alias("part"), amount.alias("amount")).where("amount is not null")
