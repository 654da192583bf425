"""Trees of accounts and grids of tables against plain Python."""

import random
from decimal import Decimal

import pytest

from tesserae.operators import statements
from tesserae.sources import grids


@pytest.mark.parametrize("seed", range(3))
def test_roll_up_of_any_tree(spark, seed):
    r = random.Random(seed)
    parent = {0: None, 1: None}
    for a in range(2, 60):
        parent[a] = r.choice([a - 1, r.randrange(a)])  # chains as well as bushes
    parent |= {100: 101, 101: 100, 102: 999}  # a ring and an orphan lead to no root
    facts = [(e, y, a, Decimal(r.randrange(-500, 500))) for e in (1, 2, None) for y in (2000, 2001, 2003) for a in r.sample(range(60), 25)]
    facts += [(1, 2000, 7, Decimal(5)), (1, 2000, 7, Decimal(6)), (1, 2000, 8, None), (1, 2000, 100, Decimal(9)), (1, 2000, 12345, Decimal(9))]
    got = statements.roll_up(
        spark.createDataFrame([(e, y, str(a), x) for e, y, a, x in facts], "entity int, period int, account string, amount decimal(20,2)"),
        spark.createDataFrame([(str(a), None if p is None else str(p), a % 5) for a, p in parent.items()], "account string, parent string, position int"),
    ).collect()
    below = {a: [c for c, p in parent.items() if p == a] for a in range(60)}
    reported = {}
    for e, y, a, x in facts:
        if x is not None and a < 60:
            reported[(e, y, a)] = reported.get((e, y, a), 0) + x

    def amount(e, y, a):
        if (e, y, a) in reported:
            return reported[(e, y, a)]
        return total(e, y, a)

    def total(e, y, a):
        known = [x for c in below[a] if (x := amount(e, y, c)) is not None]
        return sum(known) if known else None

    def level(a):
        return 0 if parent[a] is None else level(parent[a]) + 1

    want = {(e, y, a): x for e in (1, 2, None) for y in (2000, 2001, 2003) for a in range(60) if (x := amount(e, y, a)) is not None}
    assert {(g.entity, g.period, int(g.account)): g.amount for g in got} == want
    for g in got:
        key = (g.entity, g.period, int(g.account))
        assert g.total == total(*key) and g.reported == reported.get(key) and g.level == level(key[2]) and len(g.path) == g.level + 1
        assert g.prior == want.get((g.entity, g.period - 1, key[2]))
        assert g.ok == (None if g.total is None or g.reported is None else abs(g.reported - g.total) <= abs(g.reported) * Decimal("0.005"))


def test_statements_of_nothing(spark):
    facts = spark.createDataFrame([], "entity int, period int, account string, amount decimal(20,2)")
    tree = spark.createDataFrame([], "account string, parent string, position int")
    assert statements.roll_up(facts, tree).collect() == []


def plain_layout(rows):
    """Each cell takes the first free columns of its row; a cell over taken ground stays where it is."""
    ground, out = set(), []
    for r, row in enumerate(rows):
        at = 0
        for down, wide, head, text in row:
            while (r, at) in ground:
                at += 1
            down = min(down or len(rows), len(rows) - r)
            new = {(r + i, at + j) for i in range(down) for j in range(wide)}
            ground |= new
            out.append((r, at, down, wide, head, text))
            at += wide
    return out


def test_layout_is_the_plain_one():
    r = random.Random(4)
    for _ in range(400):
        rows = [[(r.choice([1, 1, 2, 3, 0]), r.choice([1, 1, 2, 3]), r.random() < 0.3, str(r.randrange(99))) for _ in range(r.randrange(5))] for _ in range(r.randrange(7))]
        assert grids.layout(rows) == plain_layout(rows)


def test_tables_inside_tables_and_odd_marks():
    body = "a <b>x</b><TABLE><tr><td rowspan=2>1<table><tr><th>in</th></tr></table>2</td><TD ALIGN='RIGHT' COLSPAN=\"2\">&lt;3&gt; <br/> 4<tr><td>5</table> b<table></table><table><td>no row</td>"
    got = list(grids.tables(body))
    assert [(b, [c[:4] + c[5:] for c in cells]) for b, cells in got] == [("", [(0, 0, 1, 1, "in")]), ("a x", [(0, 0, 2, 1, "1 2"), (0, 1, 1, 2, "<3> 4"), (1, 1, 1, 1, "5")]), ("b", [])]
    assert list(grids.tables("")) == [] and list(grids.tables("<td>x</td></table></tr>")) == []


def test_equity_changes(spark):
    head = "<TR><TH>과목</TH><TH>자본금</TH><TH>이익잉여금 합계</TH><TH>자본합계</TH></TR>"
    rows = "".join(f"<TR>{''.join(f'<TD>{x}</TD>' for x in r)}</TR>" for r in [
        ("before", "9", "9", "9"), ("2024.01.01 (기초자본)", "1,000", "-", "1,000"), ("profit", "", "(25)", "(25)"), ("2024.12.31 (기말자본)", "1,000", "(25)", "975"), ("between", "1", "1", "1"),
        ("2025.01.01 (기초)", "1,000", "(25)", "975"), ("2025.06.30 (반기말)", "7", "", "x"), ("2025.07.01 (기초자본)", "3", "3", "6"),
    ])
    docs = [(1, f"연결 자본변동표 <P>단위: 원</P> (단위 : 백만원)<TABLE>{head}{rows}</TABLE>"), (2, None), (3, "손익계산서<TABLE><TR><TH>a</TH></TR><TR><TD>1</TD></TR></TABLE>"), (1, f"자본변동표<TABLE>{head}</TABLE>")]
    got = grids.equity_changes(spark.createDataFrame(docs, "doc long, body string")).collect()
    assert sorted((str(r.ends), r.step, r.label, r.part, r.amount / 1e6) for r in got) == sorted([
        ("2024-12-31", 0, "opening", "자본금", 1000), ("2024-12-31", 0, "opening", "whole", 1000), ("2024-12-31", 1, "profit", "이익잉여금", -25), ("2024-12-31", 1, "profit", "whole", -25),
        ("2024-12-31", 2, "closing", "자본금", 1000), ("2024-12-31", 2, "closing", "이익잉여금", -25), ("2024-12-31", 2, "closing", "whole", 975),
        ("2025-06-30", 0, "opening", "자본금", 1000), ("2025-06-30", 0, "opening", "이익잉여금", -25), ("2025-06-30", 0, "opening", "whole", 975), ("2025-06-30", 1, "closing", "자본금", 7),
    ])
    assert {r.scope for r in got} == {"consolidated"} and {r.doc for r in got} == {1}
