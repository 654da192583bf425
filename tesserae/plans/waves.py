"""SQL of the queries over swings and waves: the zigzag as recursion over bars, patterns as windows, greedy cycles as a chain of edges."""

from __future__ import annotations

from tesserae.sources.views import BARS

_NEAR = lambda x, target, tolerance: f"greatest(0::DOUBLE, 1 - abs({x} - {target}::DOUBLE) / {tolerance}::DOUBLE)"

PIVOTS = f"""{BARS}, b AS (SELECT code, bar_date AS d, close AS p, row_number() OVER (PARTITION BY code ORDER BY bar_date) AS i FROM bars WHERE close IS NOT NULL),
z(code, i, way, hd, hp, ld, lp, pd, pp, kind) AS (
  SELECT code, i, 0, d, p, d, p, NULL::DATE, NULL::DOUBLE, NULL::VARCHAR FROM b WHERE i = 1
  UNION ALL
  SELECT code, i, CASE WHEN fell THEN -1 WHEN rose THEN 1 ELSE way END, CASE WHEN rose AND NOT fell THEN d ELSE hd END, CASE WHEN rose AND NOT fell THEN p ELSE hp END, CASE WHEN fell THEN d ELSE ld END, CASE WHEN fell THEN p ELSE lp END,
    CASE WHEN fell THEN hd WHEN rose THEN ld END, CASE WHEN fell THEN hp WHEN rose THEN lp END, CASE WHEN fell THEN 'high' WHEN rose THEN 'low' END
  FROM (SELECT *, way >= 0 AND p <= hp * (1 - 0.06::DOUBLE) AS fell, way <= 0 AND p >= lp * (1 + 0.06::DOUBLE) AS rose
    FROM (SELECT z.code, b.i, z.way, b.d, b.p, CASE WHEN z.way >= 0 AND b.p > z.hp THEN b.d ELSE z.hd END AS hd, CASE WHEN z.way >= 0 AND b.p > z.hp THEN b.p ELSE z.hp END AS hp,
      CASE WHEN z.way <= 0 AND b.p < z.lp THEN b.d ELSE z.ld END AS ld, CASE WHEN z.way <= 0 AND b.p < z.lp THEN b.p ELSE z.lp END AS lp FROM z JOIN b ON b.code = z.code AND b.i = z.i + 1))),
ends AS (SELECT code, max(i) AS i FROM b GROUP BY 1),
marks AS (SELECT code, i, pd, pp, kind, true AS settled FROM z WHERE kind IS NOT NULL
  UNION ALL SELECT z.code, z.i + 1, CASE WHEN way > 0 THEN hd ELSE ld END, CASE WHEN way > 0 THEN hp ELSE lp END, CASE WHEN way > 0 THEN 'high' ELSE 'low' END, false FROM z JOIN ends ON ends.code = z.code AND ends.i = z.i WHERE way <> 0),
pivots AS (SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY i) - 1 AS INTEGER) AS n, pd AS pivot_date, pp AS price, kind, settled FROM marks)"""
_LEADS = lambda k: ", ".join(f"lead(price, {i}) OVER w AS p{i}" for i in range(1, k))

IMPULSES = f"""il AS (SELECT code, n, price AS p0, kind, {_LEADS(6)}, CASE WHEN kind = 'low' THEN 1 ELSE -1 END AS s FROM pivots WINDOW w AS (PARTITION BY code ORDER BY n)),
iw AS (SELECT *, s * (p1 - p0) AS w1, -(s * (p2 - p1)) AS w2, s * (p3 - p2) AS w3, -(s * (p4 - p3)) AS w4, s * (p5 - p4) AS w5, s * (p4 - p1) AS over FROM il WHERE p5 IS NOT NULL),
impulses AS (SELECT code, n, CASE WHEN s > 0 THEN 'up' ELSE 'down' END AS direction, ({_NEAR("w2 / w1", 0.559, 0.25)} + {_NEAR("w3 / w1", 1.618, 0.6)} + {_NEAR("w4 / w3", 0.382, 0.25)}) / 3 AS score
  FROM iw WHERE least(w1, w3, w5) > 0 AND w2 < w1 AND NOT (w3 < w1 AND w3 < w5) AND over > 0 AND w2 >= 0.2::DOUBLE * w1 AND w3 >= w1 / 3 AND w3 > w2 AND w5 < 2 * w1)"""
CORRECTIONS = f"""cl AS (SELECT code, n, price AS p0, kind, {_LEADS(4)}, CASE WHEN kind = 'high' THEN 1 ELSE -1 END AS s FROM pivots WINDOW w AS (PARTITION BY code ORDER BY n)),
cr AS (SELECT *, (s * (p2 - p1)) / (s * (p0 - p1)) AS r FROM cl WHERE p3 IS NOT NULL AND s * (p0 - p1) > 0 AND s * (p2 - p1) > 0 AND s * (p2 - p3) > 0),
corrections AS (SELECT code, n, CASE WHEN kind = 'high' THEN 'down' ELSE 'up' END AS direction, CASE WHEN r <= 0.786::DOUBLE THEN 'zigzag' WHEN r <= 1.05::DOUBLE THEN 'flat' ELSE 'expanded' END AS shape,
  CASE WHEN r <= 0.786::DOUBLE THEN {_NEAR("r", 0.618, 0.4)} WHEN r <= 1.05::DOUBLE THEN 0.5::DOUBLE * {_NEAR("r", 0.9, 0.25)} ELSE 0.5::DOUBLE * {_NEAR("r", 1.236, 0.3)} END AS score FROM cr WHERE r <= 1.5)"""
# For each impulse the correction that follows it and where the search goes on; then the chain of impulses that are taken.
CYCLES = f"""{IMPULSES}, {CORRECTIONS}, many AS (SELECT code, max(n) + 1 AS pivots FROM pivots GROUP BY 1),
follow AS (SELECT i.code, i.n, i.direction, any_value(i.score) AS score, min(c.n) AS c FROM impulses i JOIN many m ON m.code = i.code LEFT JOIN corrections c ON c.code = i.code AND c.n >= i.n + 5 AND c.n < least(i.n + 13, m.pivots - 3) AND c.direction <> i.direction GROUP BY 1, 2, 3),
edge AS (SELECT f.*, min(g.n) AS next FROM follow f LEFT JOIN impulses g ON g.code = f.code AND g.n >= coalesce(f.c + 3, f.n + 5) GROUP BY ALL),
taken(code, n) AS (SELECT code, min(n) FROM impulses GROUP BY 1 UNION ALL SELECT e.code, e.next FROM taken t JOIN edge e ON e.code = t.code AND e.n = t.n WHERE e.next IS NOT NULL),
blocks AS (SELECT e.* FROM taken t JOIN edge e ON e.code = t.code AND e.n = t.n),
legs AS (SELECT code, CAST(n + k AS INTEGER) AS n, CAST(k + 1 AS VARCHAR) AS label, 'motive' AS phase, direction, round(score, 2) AS score FROM blocks, range(5) r(k)
  UNION ALL SELECT b.code, CAST(b.c + k AS INTEGER), ['A', 'B', 'C'][k + 1], 'corrective', c.direction, round(c.score, 2) FROM blocks b JOIN corrections c ON c.code = b.code AND c.n = b.c, range(3) r(k))"""
SWINGS = """swings AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN kind = 'high' THEN CASE WHEN price > before THEN 'HH' ELSE 'LH' END WHEN price > before THEN 'HL' ELSE 'LL' END AS swing FROM (SELECT *, lag(price) OVER (PARTITION BY code, kind ORDER BY n) AS before FROM pivots))"""

ORACLES = {
    "w23_zigzag": f"WITH RECURSIVE {PIVOTS} SELECT * FROM pivots",
    "w24_impulses": f"WITH RECURSIVE {PIVOTS}, {IMPULSES} SELECT code, n, direction, round(score, 6) AS score FROM impulses",
    "w25_corrections": f"WITH RECURSIVE {PIVOTS}, {CORRECTIONS} SELECT code, n, direction, shape, round(score, 6) AS score FROM corrections",
    "w26_cycles": f"WITH RECURSIVE {PIVOTS}, {CYCLES} SELECT * FROM legs",
    "w27_projections": f"""WITH RECURSIVE {PIVOTS}, {CYCLES},
placed AS (SELECT p.code, n, price, lead(price) OVER w AS after, lead(b.i) OVER w - b.i AS bars FROM pivots p JOIN b ON b.code = p.code AND b.d = p.pivot_date WINDOW w AS (PARTITION BY p.code ORDER BY n)),
r AS (SELECT l.code, l.n, label, phase, price, after, p.bars, CASE WHEN lag(phase) OVER (PARTITION BY l.code ORDER BY l.n) <> phase THEN 1 ELSE 0 END AS t FROM legs l JOIN placed p ON p.code = l.code AND p.n = l.n WHERE after IS NOT NULL),
s AS (SELECT *, sum(t) OVER (PARTITION BY code ORDER BY n) AS part FROM r),
g AS (SELECT code, part, max(phase) AS phase, arg_min(price, n) AS a, arg_max(after, n) AS e, arg_max(after > price, n) AS rose, sum(bars) AS bars, arg_max(label, n) AS label FROM s GROUP BY 1, 2),
k AS (SELECT *, abs(e - a) AS span, CASE WHEN rose THEN -1 ELSE 1 END AS way, phase = 'motive' AS m FROM g QUALIFY row_number() OVER (PARTITION BY code ORDER BY part DESC) = 1),
v AS (SELECT *, e + way * span * CASE WHEN m THEN 0.382::DOUBLE ELSE 1 END AS one, e + way * span * CASE WHEN m THEN 0.618::DOUBLE ELSE 1.618::DOUBLE END AS two FROM k WHERE span > 0)
SELECT code, label, CASE WHEN m THEN 'correction' ELSE 'advance' END AS next, round(least(one, two), 2) AS low, round(greatest(one, two), 2) AS high,
  CAST(greatest(1, floor(bars * CASE WHEN m THEN 0.382::DOUBLE ELSE 1 END)) AS INTEGER) AS bars_low, CAST(greatest(1, floor(bars * CASE WHEN m THEN 0.618::DOUBLE ELSE 1.618::DOUBLE END)) AS INTEGER) AS bars_high FROM v""",
    "w28_swings": f"WITH RECURSIVE {PIVOTS}, {SWINGS} SELECT code, n, pivot_date, price, kind, settled, swing FROM swings",
    "w28_structure": f"""WITH RECURSIVE {PIVOTS}, {SWINGS}, l AS (SELECT code, count(*) AS k, arg_max(swing, n) FILTER (kind = 'high' AND n = top) AS last_high, arg_max(swing, n) FILTER (kind = 'low' AND n = bottom) AS last_low, arg_max(kind, n) AS newest
  FROM (SELECT *, max(n) FILTER (kind = 'high') OVER (PARTITION BY code) AS top, max(n) FILTER (kind = 'low') OVER (PARTITION BY code) AS bottom FROM swings) GROUP BY 1)
SELECT code, last_high, last_low, CASE WHEN last_high = 'HH' AND last_low = 'HL' THEN 'up' WHEN last_high = 'LH' AND last_low = 'LL' THEN 'down' WHEN last_high IS NULL AND last_low IS NULL THEN 'none' ELSE 'range' END AS trend,
  CASE WHEN newest = 'low' AND last_low = 'HL' AND coalesce(last_high, '') <> 'HH' THEN 'stage 1 to 2' WHEN newest = 'high' AND last_high = 'LH' AND coalesce(last_low, '') <> 'LL' THEN 'stage 3 to 4' END AS setup FROM l WHERE k >= 3""",
    "w29_boxes": f"""WITH RECURSIVE {PIVOTS}, r AS (SELECT * FROM pivots WHERE settled QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC) <= 6),
e AS (SELECT *, max(price) FILTER (kind = 'high') OVER (PARTITION BY code) AS top, min(price) FILTER (kind = 'low') OVER (PARTITION BY code) AS bottom FROM r),
v AS (SELECT code, avg(price) FILTER (kind = 'high' AND price >= top * (1 - 0.04::DOUBLE)) AS resistance, avg(price) FILTER (kind = 'low' AND price <= bottom * (1 + 0.04::DOUBLE)) AS support FROM e GROUP BY 1),
l AS (SELECT code, close, volume, avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual, row_number() OVER w AS i, lead(bar_date) OVER w AS nxt FROM bars WINDOW w AS (PARTITION BY code ORDER BY bar_date)),
c AS (SELECT *, CASE WHEN close > resistance THEN 'breakout' WHEN close < support THEN 'breakdown' ELSE 'inside' END AS event FROM v JOIN l USING (code) WHERE resistance > support AND nxt IS NULL AND i >= 5)
SELECT code, round(support, 2) AS support, round(resistance, 2) AS resistance, event, coalesce(event <> 'inside' AND i >= 6 AND usual > 0 AND volume >= usual * 1.5, false) AS confirmed FROM c""",
}
