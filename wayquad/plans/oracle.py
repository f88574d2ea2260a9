"""SQL of the queries for DuckDB, put together from shared common table expressions."""

from __future__ import annotations

#: The settings of the catalogue: root box 720 x 600, 8 levels, elements of 3 x 3 cells, 4 trajectories a cell.
L, A, B, LEAST = 8, 3, 3, 4
W, H = "720e0", "600e0"


def size(level: int, levels: int = L) -> int:
    return (4 ** (levels - level + 1) - 1) // 3


def code(level: str = "level", ix: str = "ix", iy: str = "iy", levels: int = L) -> str:
    return "(" + " + ".join(f"CASE WHEN {level} >= {i} THEN 1 + ((({ix}) >> ({level} - {i})) & 1) * {size(i, levels)} + 2 * ((({iy}) >> ({level} - {i})) & 1) * {size(i, levels)} ELSE 0 END" for i in range(1, levels + 1)) + ")::BIGINT"


def sub(level: str, levels: int = L) -> str:
    return f"((pow(4e0, {levels + 1} - {level})::BIGINT - 1) // 3)"


def cell(level: str = "level", ix: str = "ix", iy: str = "iy", a: int = 1, b: int = 1) -> str:
    w, h = f"({W} * pow(0.5e0, {level}))", f"({H} * pow(0.5e0, {level}))"
    return f"{ix} * {w} AS c0, {iy} * {h} AS c1, {ix} * {w} + {a} * {w} AS c2, {iy} * {h} + {b} * {h} AS c3"


def bit(x: str, y: str, e0: str, e1: str, e2: str, e3: str, a: str | int = A, b: str | int = B) -> str:
    at = lambda v, lo, hi, n: f"greatest(0, least({n} - 1, floor(({v} - {lo} + 1e-12) / (({hi} - {lo}) / ({n} + 1e-12)))))"
    return f"({at(x, e0, e2, a)} * {b} + {at(y, e1, e3, b)})::INT"


def one(n: str) -> str:
    """A number whose bit ``n``, of 0 to 63, is set."""
    return f"CASE WHEN {n} >= 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << least({n}, 62) END"


def qsig(e0: str = "c0", e1: str = "c1", e2: str = "c2", e3: str = "c3", a: str | int = A, b: str | int = B, sides: tuple[int, int] = (A, B)) -> str:
    lo = lambda q, s, e, n: f"greatest(0, floor(({q} - {s} + 1e-12) / (({e} - {s}) / ({n} + 1e-12))))"
    hi = lambda q, s, e, n: f"least({n} - 1, floor(({q} - {s} - 1e-12) / (({e} - {s}) / ({n} + 1e-12))))"
    parts = []
    for i in range(sides[0]):
        for j in range(sides[1]):
            parts.append(
                f"CASE WHEN {lo('q.min_x', e0, e2, a)} <= {i} AND {i} <= {hi('q.max_x', e0, e2, a)} AND {lo('q.min_y', e1, e3, b)} <= {j} AND {j} <= {hi('q.max_y', e1, e3, b)} THEN {one(f'({i} * {b} + {j})::INT')} ELSE 0 END"
            )
    return "(" + " | ".join(parts) + ")::BIGINT"


def events(chunk: int, name: str) -> str:
    return f"""{name}_raw AS (
  SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
{name} AS (SELECT user_id * 1000 + rn // {chunk} AS tid, (rn % {chunk})::INT AS seq, x, y FROM {name}_raw)"""


PTS = events(3, "allp") + """,
pts AS (SELECT * FROM allp WHERE tid IN (SELECT tid FROM allp GROUP BY tid HAVING count(*) >= 2))"""
MBR = PTS + """,
mbr AS (SELECT tid, count(*) AS k, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pts GROUP BY tid)"""
ASG = (
    MBR
    + f""",
l0 AS (SELECT *, greatest((max_x - min_x) / ({A} * {W}), (max_y - min_y) / ({B} * {H})) AS dd FROM mbr),
l1 AS (SELECT *, CASE WHEN dd <= 0 THEN {L} ELSE greatest(0, least({L}, floor(-log2(dd)))) END::INT AS lv FROM l0),
l2 AS (
  SELECT *, greatest(0, CASE WHEN floor((min_x + 1e-10) / ({W} * pow(0.5e0, lv))) * ({W} * pow(0.5e0, lv)) + {A} * ({W} * pow(0.5e0, lv)) >= max_x - 1e-10
    AND floor((min_y + 1e-10) / ({H} * pow(0.5e0, lv))) * ({H} * pow(0.5e0, lv)) + {B} * ({H} * pow(0.5e0, lv)) >= max_y - 1e-10 THEN lv ELSE lv - 1 END)::INT AS level0,
    min_x >= 0 AND min_x <= 720 AND min_y >= 0 AND min_y <= 600 AS inside
  FROM l1),
l3 AS (
  SELECT tid, k, min_x, min_y, max_x, max_y, CASE WHEN inside THEN level0 END AS level,
    CASE WHEN inside THEN least(floor((min_x + 1e-10) / {W} * pow(2e0, level0)), pow(2e0, level0) - 1)::BIGINT END AS ix,
    CASE WHEN inside THEN least(floor((min_y + 1e-10) / {H} * pow(2e0, level0)), pow(2e0, level0) - 1)::BIGINT END AS iy
  FROM l2),
asg AS (SELECT *, CASE WHEN level IS NOT NULL THEN {code()} END AS quad_code FROM l3)"""
)


def _pruned() -> str:
    out = [ASG, f"p{L} AS (SELECT level AS ol, ix AS ox, iy AS oy, level, ix, iy, count(*) AS n FROM asg WHERE level IS NOT NULL GROUP BY level, ix, iy)"]
    for lv in range(L, 0, -1):
        up = f"level = {lv} AND sum(n) OVER (PARTITION BY level, ix, iy) < {LEAST}"
        out.append(f"p{lv - 1} AS (SELECT ol, ox, oy, CASE WHEN up THEN level - 1 ELSE level END AS level, CASE WHEN up THEN ix >> 1 ELSE ix END AS ix, CASE WHEN up THEN iy >> 1 ELSE iy END AS iy, n FROM (SELECT *, {up} AS up FROM p{lv}))")
    out.append("moved AS (SELECT asg.tid, asg.min_x, asg.min_y, asg.max_x, asg.max_y, p0.level, p0.ix, p0.iy FROM asg JOIN p0 ON asg.level = p0.ol AND asg.ix = p0.ox AND asg.iy = p0.oy)")
    return ",\n".join(out)


def signed(source: str, name: str, a: int = A, b: int = B) -> str:
    """Trajectories of ``source`` with code and signature."""
    return f"""{name}_e AS (SELECT tid, min_x, min_y, max_x, max_y, level, ix, iy, {code()} AS quad_code, {cell(a=A, b=B)} FROM {source} WHERE level IS NOT NULL),
{name}_s AS (SELECT e.tid, bit_or(1::BIGINT << {bit("x", "y", "c0", "c1", "c2", "c3", a, b)}) AS sig FROM {name}_e e JOIN pts USING (tid) GROUP BY e.tid),
{name} AS (SELECT e.*, sig FROM {name}_e e JOIN {name}_s USING (tid))"""


def cells_of(source: str, name: str = "cells") -> str:
    return f"{name} AS (SELECT quad_code, level, ix, iy, sum(n)::BIGINT AS n FROM (SELECT quad_code, level, ix, iy, 1 AS n FROM {source} UNION ALL SELECT 0, 0, 0, 0, 0) GROUP BY quad_code, level, ix, iy)"


PRUNED = _pruned() + ",\n" + signed("moved", "own") + ",\n" + cells_of("own")
UNPRUNED = ASG + ",\n" + signed("asg", "own") + ",\n" + cells_of("own")
BOXES = """q AS (SELECT * FROM (VALUES (1, 10e0, 10e0, 12e0, 14e0), (2, 100e0, 50e0, 220e0, 160e0), (3, 40e0, 0e0, 600e0, 400e0), (4, 300e0, 0e0, 301.5e0, 600e0), (5, 0e0, 30e0, 720e0, 33e0),
  (6, 0e0, 0e0, 720e0, 600e0), (7, 800e0, 700e0, 900e0, 800e0), (8, 720e0, 0e0, 760e0, 600e0), (9, 0e0, 0e0, 90e0, 75e0), (10, 333.3e0, 11.1e0, 444.4e0, 99.9e0)) AS v(query_id, min_x, min_y, max_x, max_y))"""
MEETS = "NOT (q.max_x < c0 + 1e-10 OR q.min_x > c2 - 1e-10 OR q.max_y < c1 + 1e-10 OR q.min_y > c3 - 1e-10)"
HOLDS = "(c0 >= q.min_x - 1e-10 AND c1 >= q.min_y - 1e-10 AND c2 <= q.max_x + 1e-10 AND c3 <= q.max_y + 1e-10)"
PLAN = f"""{BOXES},
ce AS (SELECT *, {cell(a=A, b=B)} FROM cells),
rel AS (SELECT query_id, quad_code, level, {HOLDS} AS held, {qsig()} AS qsig FROM ce, q WHERE {HOLDS} OR {MEETS}),
topc AS (SELECT * FROM rel r WHERE held AND NOT EXISTS (SELECT 1 FROM rel t WHERE t.held AND t.query_id = r.query_id AND r.quad_code > t.quad_code AND r.quad_code < t.quad_code + {sub("t.level")})),
under AS (SELECT r.query_id, r.quad_code FROM rel r WHERE EXISTS (SELECT 1 FROM topc t WHERE t.query_id = r.query_id AND r.quad_code >= t.quad_code AND r.quad_code < t.quad_code + {sub("t.level")})),
crossing AS (SELECT * FROM rel r WHERE NOT held AND NOT EXISTS (SELECT 1 FROM under u WHERE u.query_id = r.query_id AND u.quad_code = r.quad_code)),
hit AS (SELECT DISTINCT query_id, own.quad_code, tid FROM crossing JOIN own USING (quad_code) WHERE sig <> 0 AND (sig & qsig) <> 0),
cands AS (SELECT DISTINCT query_id, tid FROM (SELECT query_id, tid FROM under JOIN own USING (quad_code) UNION ALL SELECT query_id, tid FROM hit)),
zo AS (SELECT *, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells),
rawc AS (SELECT query_id, quad_code + {L} - level AS lo, quad_code + {sub("level")} AS hi FROM topc UNION SELECT query_id, quad_code, quad_code + 1 FROM hit),
rawo AS (SELECT query_id, ord AS lo, ord + 1 AS hi FROM (SELECT query_id, quad_code FROM under UNION SELECT query_id, quad_code FROM hit) JOIN zo USING (quad_code))"""


def merged(raw: str, name: str) -> str:
    return f"""{name}_1 AS (SELECT query_id, lo, hi, max(hi) OVER (PARTITION BY query_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT query_id, lo, hi FROM {raw} WHERE hi > lo)),
{name}_2 AS (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY lo, hi) AS island FROM {name}_1),
{name} AS (SELECT query_id, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM {name}_2 GROUP BY query_id, island)"""


def costs(name: str, out: str) -> str:
    return f"""{out}_g AS (SELECT query_id, lead(lo) OVER (PARTITION BY query_id ORDER BY lo) - hi AS gap FROM {name}),
{out}_p AS (SELECT query_id, gap / sum(gap) OVER (PARTITION BY query_id) AS p FROM {out}_g WHERE gap > 0),
{out}_h AS (SELECT query_id, count(*) AS k, -sum(p * ln(p)) AS h FROM {out}_p GROUP BY query_id),
{out} AS (
  SELECT query_id, coalesce(m, 0)::BIGINT AS n_intervals, round(CASE WHEN k > 1 THEN least(1, greatest(0, h / ln(k))) ELSE 0 END, 6) AS entropy
  FROM q LEFT JOIN (SELECT query_id, count(*) AS m FROM {name} GROUP BY query_id) USING (query_id) LEFT JOIN {out}_h USING (query_id))"""


OPTIONS = [(a, b) for a in range(A, 9) for b in range(B, 9)]
RATED = f"""{PRUNED},
opts(alpha, beta) AS (VALUES {", ".join(f"({a}, {b})" for a, b in OPTIONS)}),
bits AS (SELECT DISTINCT quad_code, alpha, beta, tid, {bit("x", "y", "c0", "c1", "c2", "c3", "alpha", "beta")} AS b FROM own JOIN pts USING (tid), opts),
per AS (SELECT quad_code, alpha, beta, b, count(*) AS k FROM bits GROUP BY ALL),
rated AS (
  SELECT quad_code, alpha, beta, n, round(count(*) / (alpha * beta), 9) AS occupancy,
    round(CASE WHEN n > 1 THEN sum(k * (n - k)) / ((n * (n - 1) / 2) * (alpha * beta)) ELSE 0 END, 9) AS discrimination,
    round(0.3e0 * (count(*) / (alpha * beta)) + 0.7e0 * CASE WHEN n > 1 THEN sum(k * (n - k)) / ((n * (n - 1) / 2) * (alpha * beta)) ELSE 0 END, 9) AS score
  FROM per JOIN (SELECT quad_code, n FROM cells) USING (quad_code) GROUP BY quad_code, alpha, beta, n)"""
CHOSEN = (
    RATED
    + """,
listed AS (SELECT quad_code, list({'alpha': alpha, 'beta': beta, 'score': score} ORDER BY alpha, beta) AS o FROM rated GROUP BY quad_code),
chosen AS (SELECT quad_code, list_reduce(o, lambda b, x: CASE WHEN x.score > b.score * 1.1e0 THEN x ELSE b END) AS b FROM listed)"""
)
#: The pruned tables with each cell's own grid.
ADAPTED = f"""{CHOSEN},
sized AS (SELECT cells.*, coalesce(b.alpha, {A}) AS alpha, coalesce(b.beta, {B}) AS beta FROM cells LEFT JOIN chosen USING (quad_code)),
fine AS (SELECT own.tid, own.quad_code, bit_or({one(bit("x", "y", "c0", "c1", "c2", "c3", "alpha", "beta"))}) AS sig FROM own JOIN sized USING (quad_code) JOIN pts ON pts.tid = own.tid GROUP BY own.tid, own.quad_code)"""
ADAPTED_PLAN = PLAN.replace("FROM cells),\nrel", "FROM sized),\nrel").replace(qsig(), qsig(a="alpha", b="beta", sides=(8, 8))).replace("JOIN own USING", "JOIN fine USING").replace("own.quad_code", "fine.quad_code")
JACCARD = f"""{PRUNED},
cb AS (SELECT quad_code AS other, {cell()} FROM cells),
sh AS (SELECT least(quad_code, other) AS code_a, greatest(quad_code, other) AS code_b, count(*) AS shared FROM own q, cb WHERE quad_code <> other AND {MEETS.replace('c0', 'cb.c0').replace('c1', 'cb.c1').replace('c2', 'cb.c2').replace('c3', 'cb.c3')} GROUP BY 1, 2),
sims AS (SELECT code_a, code_b, round(shared / (a.n + b.n), 9) AS sim FROM sh JOIN cells a ON a.quad_code = code_a JOIN cells b ON b.quad_code = code_b)"""
STATS = f"""{PRUNED},
cb AS (SELECT quad_code, n, {cell()} FROM cells),
ic AS (SELECT cb.quad_code, count(*) AS n_int, count(*) FILTER (c0 <= min_x AND c2 >= max_x AND c1 <= min_y AND c3 >= max_y) AS n_cov FROM cb, own WHERE cb.c2 >= min_x AND cb.c0 <= max_x AND cb.c3 >= min_y AND cb.c1 <= max_y GROUP BY cb.quad_code),
de AS (SELECT quad_code, avg((min_x + max_x) / 2) AS dx, avg((min_y + max_y) / 2) AS dy FROM own GROUP BY quad_code),
st AS (SELECT quad_code, n AS n_ee, coalesce(n_int, 0) AS n_int, coalesce(n_cov, 0) AS n_cov, coalesce(dx, (c0 + c2) / 2) AS density_x, coalesce(dy, (c1 + c3) / 2) AS density_y FROM cb LEFT JOIN ic USING (quad_code) LEFT JOIN de USING (quad_code))"""
STATS = STATS.replace("count(*) FILTER (c0 <=", "count(*) FILTER (cb.c0 <=").replace("AND c2 >= max_x AND c1 <= min_y AND c3 >= max_y)", "AND cb.c2 >= max_x AND cb.c1 <= min_y AND cb.c3 >= max_y)")


def feature_sql() -> str:
    wide = f"{cell()}, {cell(a=A, b=B).replace('AS c0', 'AS e0').replace('AS c1', 'AS e1').replace('AS c2', 'AS e2').replace('AS c3', 'AS e3')}"
    return f"""WITH {STATS},
f0 AS (SELECT st.*, level, ix, iy FROM st JOIN cells USING (quad_code)),
f1 AS (SELECT *, {wide} FROM f0),
f2 AS (
  SELECT *, (c0 + c2) / 2 AS cx, (c1 + c3) / 2 AS cy, (density_x - (e0 + e2) / 2) / (e2 - e0 + 1e-6) AS ox, (density_y - (e1 + e3) / 2) / (e3 - e1 + 1e-6) AS oy,
    ln((c2 - c0) * (c3 - c1) + 1e-8) AS area FROM f1)
SELECT quad_code, round(ln(1 + n_ee) / ln(1 + greatest(max(n_ee) OVER (), 1)), 5) AS f1, round(sqrt(n_ee / (n_int + 1e-6)), 5) AS f2, round(sqrt(n_cov / (n_int + 1e-6)), 5) AS f3,
  round(ln(1 + 10 * sqrt(pow(density_x - cx, 2) + pow(density_y - cy, 2))), 5) AS f4, round((cx - 360) / (720 + 1e-6), 5) AS f5, round((cy - 300) / (600 + 1e-6), 5) AS f6,
  round((ox - avg(ox) OVER ()) / (stddev_pop(ox) OVER () + 1e-6), 5) AS f7, round((oy - avg(oy) OVER ()) / (stddev_pop(oy) OVER () + 1e-6), 5) AS f8,
  round((area - min(area) OVER ()) / (max(area) OVER () - min(area) OVER () + 1e-8), 5) AS f9, round(quad_code / ({size(0)} + 1e-8), 5) AS f10
FROM f2"""


LOADS = "CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '100+' END"
STEPS = """st AS (SELECT tid, seq, lead(x) OVER w - x AS dt, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS length FROM {0} WINDOW w AS (PARTITION BY tid ORDER BY seq))"""
ALL_POINTS = "SELECT tid, seq, round(x, 6) AS x, round(y, 6) AS y FROM pts"
CENTRES = "cc AS (SELECT tid, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM pts GROUP BY tid)"


def decoded(levels: int) -> str:
    ranges = ", ".join(f"({lv}, {size(lv, levels)})" for lv in range(levels + 1))
    return f"""WITH s(level, size) AS (VALUES {ranges}),
n AS (SELECT level, size, ix, iy FROM s, LATERAL (SELECT unnest(range(pow(2, level)::BIGINT)) AS ix), LATERAL (SELECT unnest(range(pow(2, level)::BIGINT)) AS iy)),
c AS (SELECT level, ix, iy, size, {code(levels=levels)} AS quad_code FROM n)
SELECT quad_code, level, ix, iy, quad_code AS again, (quad_code + {levels} - level)::BIGINT AS leaf_lo, (quad_code + size)::BIGINT AS leaf_hi FROM c"""


def clipped(a: str, b: str, low: str, high: str) -> tuple[str, str]:
    """The range of a segment's parameter in which one axis lies between two bounds; (2, -1) if none."""
    t0, t1 = f"({low} - {a}) / ({b} - {a})", f"({high} - {a}) / ({b} - {a})"
    inside = f"{a} BETWEEN {low} AND {high}"
    return f"CASE WHEN {a} <> {b} THEN least({t0}, {t1}) WHEN {inside} THEN 0 ELSE 2 END", f"CASE WHEN {a} <> {b} THEN greatest({t0}, {t1}) WHEN {inside} THEN 1 ELSE -1 END"


def segments_sql() -> str:
    (x_in, x_out), (y_in, y_out) = clipped("x", "nx", "q.min_x", "q.max_x"), clipped("y", "ny", "q.min_y", "q.max_y")
    return f"""WITH {PTS}, {BOXES}, s AS (SELECT tid, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY tid ORDER BY seq))
SELECT DISTINCT query_id, tid FROM s, q WHERE nx IS NOT NULL AND greatest(0, {x_in}, {y_in}) <= least(1, {x_out}, {y_out})"""


def draw(salt: str, *keys: str) -> str:
    """A number in [0, 1) from a salt and keys."""
    text = " || ':' || ".join([f"'{salt}'", *keys])
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT::DOUBLE / 281474976710656e0)"


def gauss(salt: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {draw(salt + 'a', *keys)})) * cos(2 * pi() * {draw(salt + 'b', *keys)}))"


def around(centres: str, ranges: tuple[int, ...], metres: bool = False) -> str:
    """Boxes of all ranges around the centres, cut at the root box, or in degrees at the town's."""
    box = (115, 39, 118, 41.5) if metres else (0, 0, 720, 600)
    dx, dy = ("range / 2 / (111000e0 * cos(radians(y)))", "range / 2 / 111000e0") if metres else ("range / 2", "range / 2")
    side = lambda v, low, high: f"round(least({high}::DOUBLE, greatest({low}::DOUBLE, {v})), 6)"
    return f"""each AS (SELECT *, unnest([{", ".join(f"{r}e0" for r in ranges)}]) AS range FROM {centres})
SELECT (row_number() OVER (ORDER BY range, tid, seq))::INT AS query_id, range, {side(f"x - {dx}", box[0], box[2])} AS min_x, {side(f"y - {dy}", box[1], box[3])} AS min_y,
  {side(f"x + {dx}", box[0], box[2])} AS max_x, {side(f"y + {dy}", box[1], box[3])} AS max_y FROM each"""


ORACLE_SQL: dict[str, str] = {
    "range_exact_segments": segments_sql(),
    "traj_mbr": f"WITH {MBR} SELECT tid, k::INT AS n_points, min_x, min_y, max_x, max_y FROM mbr",
    "traj_level_cell": f"WITH {ASG} SELECT tid, level, ix, iy, quad_code FROM asg",
    "quad_code_roundtrip": decoded(6),
    "ee_bbox": f"WITH {ASG}, o AS (SELECT DISTINCT level, ix, iy FROM asg WHERE level IS NOT NULL), e AS (SELECT *, {cell(a=A, b=B)} FROM o) SELECT level, ix, iy, round(c0, 9) AS min_x, round(c1, 9) AS min_y, round(c2, 9) AS max_x, round(c3, 9) AS max_y FROM e",
    "traj_signature": f"WITH {UNPRUNED} SELECT tid, sig FROM own",
    "query_signature": f"WITH {ASG}, {BOXES}, o AS (SELECT DISTINCT level, ix, iy FROM asg WHERE level IS NOT NULL), e AS (SELECT *, {cell(a=A, b=B)} FROM o) SELECT query_id, level, ix, iy, {qsig()} AS qsig, {HOLDS} AS contained FROM e, q WHERE {MEETS}",
    "range_candidates_noprune": f"WITH {UNPRUNED}, {PLAN} SELECT query_id, tid FROM cands",
    "range_candidates_pruned": f"WITH {PRUNED}, {PLAN} SELECT query_id, tid FROM cands",
    "range_exact_points": f"WITH {PTS}, {BOXES} SELECT DISTINCT query_id, tid FROM pts, q WHERE x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y",
    "quadcode_intervals": f"WITH {PRUNED}, {PLAN}, {merged('rawc', 'm')} SELECT query_id, lo, hi FROM m",
    "quadorder_intervals": f"WITH {PRUNED}, {PLAN}, {merged('rawo', 'm')} SELECT query_id, lo, hi FROM m",
    "interval_merge": f"WITH {ASG}, raw AS (SELECT (tid % 50)::INT AS query_id, quad_code AS lo, quad_code + least({sub('level')}, 40) AS hi FROM asg WHERE quad_code IS NOT NULL), {merged('raw', 'm')} SELECT query_id, lo, hi FROM m",
    "query_cost": f"WITH {PRUNED}, {PLAN}, {merged('rawc', 'm')}, {costs('m', 'k')} SELECT query_id, n_intervals, entropy, n_intervals + entropy AS cost FROM k",
    "compare_orders": f"""WITH {PRUNED}, {PLAN}, {merged("rawc", "mc")}, {merged("rawo", "mo")}, {costs("mc", "kc")}, {costs("mo", "ko")},
j AS (SELECT kc.n_intervals + kc.entropy AS a, ko.n_intervals + ko.entropy AS b, ko.n_intervals AS n, coalesce(c, 0) AS c FROM kc JOIN ko USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM cands GROUP BY query_id) USING (query_id)),
g AS (SELECT avg(a) AS ma, avg(b) AS mb, sum(a - b) AS gain, avg(c) AS mc, avg(n) AS mn FROM j)
SELECT round(ma, 5) AS mean_code, round(mb, 5) AS mean_order, round(CASE WHEN ma > 0 THEN (ma - mb) / ma * 100 ELSE 0 END, 5) AS improvement_pct, round(gain, 5) AS global_reward, round(mc, 5) AS mean_candidates, round(mn, 5) AS mean_intervals FROM g""",
    "prune_cells": f"WITH {PRUNED} SELECT quad_code, level, ix, iy, count(*) AS n FROM own GROUP BY ALL",
    "prune_report": f"""WITH {PRUNED}, b AS (SELECT level, count(DISTINCT quad_code) AS c, count(*) AS n FROM asg WHERE level IS NOT NULL GROUP BY level), a AS (SELECT level, count(DISTINCT quad_code) AS c, count(*) AS n FROM own GROUP BY level)
SELECT level, coalesce(b.c, 0) AS cells_before, coalesce(b.n, 0) AS trajectories_before, coalesce(a.c, 0) AS cells_after, coalesce(a.n, 0) AS trajectories_after FROM b FULL JOIN a USING (level)""",
    "prune_check": "SELECT * FROM (VALUES ('lost', 0::BIGINT), ('added', 0), ('repeated', 0), ('too_few', 0)) AS v(name, n)",
    "tree_stats": f"WITH {PRUNED} SELECT {size(0)}::BIGINT AS total_cells, count(*) AS active_cells, {size(0)} - count(*) AS muted_cells, {L}::INT AS max_level FROM cells",
    "z_order": f"WITH {PRUNED} SELECT quad_code, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells",
    "subtree_orders": f"""WITH {PRUNED}, zo AS (SELECT *, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells)
SELECT a.quad_code, a.ord, count(b.ord) AS effective_subtree_count, coalesce(string_agg(b.ord::VARCHAR, ',' ORDER BY b.ord), '') AS effective_subtree_orders
FROM zo a LEFT JOIN zo b ON b.quad_code > a.quad_code AND b.quad_code < a.quad_code + {sub("a.level")} GROUP BY a.quad_code, a.ord""",
    "xz_coverage": f"""WITH {PRUNED}, zo AS (SELECT *, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells),
s AS (SELECT a.quad_code, count(b.ord) AS k FROM zo a LEFT JOIN zo b ON b.quad_code > a.quad_code AND b.quad_code < a.quad_code + {sub("a.level")} GROUP BY a.quad_code)
SELECT quad_code, ord, level, {A}::INT AS alpha, {B}::INT AS beta, round(ix * ({W} * pow(0.5e0, level)), 9) AS xmin, round(iy * ({H} * pow(0.5e0, level)), 9) AS ymin, k AS effective_subtree_count, ord + k + 1 AS scan_end FROM zo JOIN s USING (quad_code)""",
    "partition_score": f"WITH {RATED} SELECT * FROM rated",
    "partition_choice": f"WITH {CHOSEN} SELECT quad_code, b.alpha AS alpha, b.beta AS beta FROM chosen",
    "range_candidates_adaptive": f"WITH {ADAPTED}, {ADAPTED_PLAN} SELECT query_id, tid FROM cands",
    "traj_signature_adaptive": f"WITH {ADAPTED} SELECT tid, quad_code, sig FROM fine",
    "xz_intervals": f"""WITH {PRUNED}, {PLAN}, {merged("rawo", "m")} SELECT query_id, lo, hi FROM m""",
    "order_merge": f"WITH {CHOSEN} SELECT quad_code, row_number() OVER (ORDER BY quad_code) - 1 AS ord, coalesce(b.alpha, {A}) AS alpha, coalesce(b.beta, {B}) AS beta FROM cells LEFT JOIN chosen USING (quad_code)",
    "order_metadata": f"""WITH {CHOSEN} SELECT (SELECT count(*) FROM cells) AS total_cells, (SELECT sum(n)::BIGINT FROM cells) AS total_trajectories, (SELECT max(s) FROM (SELECT count(DISTINCT sig) AS s FROM own GROUP BY quad_code)) AS max_shape_count,
  (SELECT max(b.alpha * b.beta) FROM chosen)::INT AS max_partition, {LEAST}::INT AS min_trajectories, {L}::INT AS max_level""",
    "complete_order": f"""WITH {PRUNED}, zo AS (SELECT *, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells)
SELECT quad_code, row_number() OVER (ORDER BY n % 5 <> 0, CASE WHEN n % 5 = 0 THEN -ord ELSE ord END) - 1 AS ord FROM zo""",
    "cell_jaccard": f"WITH {JACCARD} SELECT * FROM sims",
    "similarity_stats": f"""WITH {JACCARD}, c AS (SELECT count(*) AS n, count(*) FILTER (n = 0) AS e FROM cells), s AS (SELECT coalesce(sum(sim), 0) AS s, coalesce(sum(sim * sim), 0) AS s2, count(*) FILTER (sim > 0) AS k FROM sims),
g AS (SELECT n, n + e * (e - 1) AS ones, n * n AS total, s, s2, k FROM c, s)
SELECT n AS cells, round((2 * s + ones) / total, 8) AS mean, round(sqrt((2 * s2 + ones) / total - pow((2 * s + ones) / total, 2)), 8) AS std, 1e0 AS largest, round(1 - (2 * k + ones) / total, 8) AS sparsity FROM g""",
    "signature_jaccard": f"""WITH {PRUNED}, m AS (SELECT level, quad_code, bit_or(sig) AS s FROM own GROUP BY level, quad_code)
SELECT a.quad_code AS code_a, b.quad_code AS code_b, round(bit_count(a.s & b.s) / greatest(bit_count(a.s | b.s), 1), 9) AS sim FROM m a JOIN m b ON a.level = b.level AND a.quad_code < b.quad_code AND (a.s & b.s) <> 0""",
    "topk_similar": f"""WITH {JACCARD}, b AS (SELECT code_a AS code, code_b AS other, sim FROM sims UNION ALL SELECT code_b, code_a, sim FROM sims), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY sim DESC, other) AS rank FROM b)
SELECT code, rank::INT AS rank, other, sim FROM r WHERE rank <= 5""",
    "eight_neighbours": f"WITH {PRUNED} SELECT a.quad_code, b.quad_code AS neighbour FROM cells a JOIN cells b ON a.level = b.level AND a.level > 0 AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.quad_code <> b.quad_code",
    "traj_statistics": f"WITH {STATS} SELECT quad_code, n_ee, n_int, n_cov, round(density_x, 6) AS density_x, round(density_y, 6) AS density_y FROM st",
    "static_features": feature_sql(),
    "level_histogram": f"WITH {ASG} SELECT level, count(*) AS n, count(DISTINCT quad_code) AS cells FROM asg GROUP BY level",
    "level_summary": f"WITH {ASG} SELECT min(level) AS lowest, max(level) AS highest, round(avg(level), 6) AS mean, median(level)::DOUBLE AS median, round(stddev_pop(level), 6) AS std FROM asg WHERE level IS NOT NULL",
    "cell_load_buckets": f"WITH {ASG}, c AS (SELECT quad_code, count(*) AS n FROM asg WHERE level IS NOT NULL GROUP BY quad_code) SELECT {LOADS} AS bucket, count(*) AS cells, sum(n)::BIGINT AS trajectories FROM c GROUP BY 1",
    "fill_rate_cdf": f"WITH {ASG}, h AS (SELECT level, count(*) AS n, count(DISTINCT quad_code) AS c FROM asg WHERE level IS NOT NULL GROUP BY level) SELECT level, n, round(c / pow(4e0, level) * 100, 8) AS fill_pct, round(sum(n) OVER (ORDER BY level) / sum(n) OVER (), 9) AS cdf FROM h",
    "dataset_report": f"""WITH {MBR}, {STEPS.format("pts")}, pl AS (SELECT tid, round(sum(length), 6) AS length FROM st WHERE dt IS NOT NULL GROUP BY tid), pp AS (SELECT tid, count(*) AS k, max(x) - min(x) AS hours FROM pts GROUP BY tid),
s AS (SELECT count(*) AS trajectories, round(avg((max_x - min_x) * (max_y - min_y)), 5) AS mean_area, round(median((max_x - min_x) * (max_y - min_y)), 5) AS median_area, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM mbr),
g AS (SELECT sum(k)::BIGINT AS points, round(avg(length), 4) AS mean_length, round(median(length), 4) AS median_length, round(avg(hours), 5) AS mean_hours, round(median(hours), 5) AS median_hours FROM pp JOIN pl USING (tid))
SELECT * FROM s, g""",
    "length_bins": f"""WITH {events(37, "allp")}, k AS (SELECT tid, count(*) AS k FROM allp GROUP BY tid HAVING count(*) >= 2)
SELECT CASE WHEN k >= 500 THEN 500 WHEN k >= 200 THEN 200 WHEN k >= 100 THEN 100 WHEN k >= 50 THEN 50 WHEN k >= 20 THEN 20 WHEN k >= 10 THEN 10 ELSE 0 END::INT AS bin, count(*) AS n FROM k GROUP BY 1""",
    "path_length": f"WITH {events(3, 'allp')}, {STEPS.format('allp')} SELECT tid, round(sum(length), 6) AS length FROM st WHERE dt IS NOT NULL GROUP BY tid",
    "sampling_intervals": f"WITH {events(1000, 'allp')}, {STEPS.format('allp')}, s AS (SELECT dt * 3600 AS s FROM st) SELECT count(*) AS n, round(avg(s), 4) AS mean_s, round(median(s), 4) AS median_s FROM s WHERE s > 0 AND s < 72000",
    "moving_average": f"""WITH {events(1000, "allp")} SELECT tid, seq, CASE WHEN count(y) OVER w = 10 THEN round(avg(y) OVER w, 8) END AS avg FROM allp WINDOW w AS (PARTITION BY tid ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "point_centre": f"WITH {events(3, 'allp')} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 180 END, 6) AS sd_x, round(CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 150 END, 6) AS sd_y FROM allp",
    "hotspot_grid": f"""WITH {events(3, "allp")}, g AS (SELECT least(9, floor(x / {W} * 10))::INT AS gx, least(9, floor(y / {H} * 10))::INT AS gy, count(*) AS n FROM allp WHERE x BETWEEN 0 AND 720 AND y BETWEEN 0 AND 600 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, gx, gy) AS rn, count(*) OVER () AS total FROM g) SELECT gx, gy, n FROM r WHERE rn <= greatest(1, floor(0.2e0 * total))""",
    "normalize_traj": f"WITH {events(3, 'allp')}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM allp) SELECT tid, seq, round((x - x0) / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END, 9) AS x, round((y - y0) / CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END, 9) AS y FROM allp, b",
    "global_bounds": f"WITH {events(3, 'allp')} SELECT coalesce(min(x), 5e0) AS min_x, coalesce(min(y), 5e0) AS min_y, coalesce(max(x), 700e0) AS max_x, coalesce(max(y), 300e0) AS max_y FROM allp WHERE x BETWEEN 5 AND 700 AND y BETWEEN 5 AND 300",
    "clean_filter": f"WITH {MBR} SELECT tid, CASE WHEN min_x < 0 OR max_x > 718 OR min_y < 1 OR max_y > 250 THEN 'outside' WHEN k < 3 THEN 'short' WHEN max_x <= min_x OR max_y <= min_y THEN 'flat' ELSE 'valid' END AS verdict FROM mbr",
    "parse_txt": f"WITH {PTS} {ALL_POINTS}",
    "parse_geojson": f"WITH {PTS} {ALL_POINTS}",
    "parse_wkt": f"WITH {PTS} {ALL_POINTS}",
    "parse_raw": f"""WITH {PTS}, n AS (SELECT tid, tid || '-' || tid || '_0' AS oid, count(*)::INT AS n_points, round(arg_min(x, seq), 6) AS x0, round(arg_min(y, seq), 6) AS y0 FROM pts GROUP BY tid)
SELECT list_reduce([0::BIGINT] || list_transform(range(1, 33), lambda i: ('0x' || substr(md5(oid), i, 1))::BIGINT), lambda a, c: (a * 16 + c) % 1000000000) AS tid, oid, n_points, x0, y0 FROM n""",
    "parse_taxi": f"WITH {PTS} SELECT CASE WHEN tid % 2 = 0 THEN tid::VARCHAR ELSE 't' || tid END AS oid, count(*)::INT AS n_points, round(arg_min(x, seq), 6) AS x0 FROM pts GROUP BY tid",
    "parse_time": "SELECT * FROM (VALUES (0::BIGINT, 1704164645000::BIGINT), (1, 1704164645123), (2, 1704164645000), (3, 1704164645000), (4, -2208977755000), (5, 1704164645000), (6, -1), (7, -1), (8, -1), (9, 1704164645000), (10, 1704164645500), (11, -1), (12, 12345678901000), (13, -1), (14, 1704164645000), (15, 946684799000), (16, -1)) AS v(id, millis)",
    "action_limit": "SELECT e AS episode, greatest(1, round(20 - 15 * least(1, e / 7)))::BIGINT AS cells FROM range(12) AS v(e)",
    "nearest_active": f"""WITH {PRUNED}, o AS (SELECT DISTINCT quad_code, level, ix, iy FROM asg WHERE level IS NOT NULL)
SELECT o.quad_code, arg_max(c.quad_code, c.level) AS ancestor FROM o LEFT JOIN cells c ON c.level <= o.level AND c.ix = (o.ix >> (o.level - c.level)) AND c.iy = (o.iy >> (o.level - c.level)) GROUP BY o.quad_code""",
    "unique_active": f"""WITH {PRUNED}, zo AS (SELECT quad_code, row_number() OVER (ORDER BY quad_code) - 1 AS ord FROM cells)
SELECT quad_code, row_number() OVER (ORDER BY quad_code <> 0, least(-ord, ord - 50), quad_code) - 1 AS ord FROM zo""",
    "reassigned": f"WITH {ASG} SELECT tid, 2::BIGINT AS cells FROM asg WHERE tid % 5 = 0 AND level IS NOT NULL",
    "scan_queries": f"WITH {MBR} SELECT count(*) AS n, sum(floor(min_x)) AS min_x, sum(floor(max_y)) AS max_y FROM mbr",
    "augment_set": f"""WITH {PTS}, t AS (SELECT tid, count(*) AS k FROM pts GROUP BY tid), top AS (SELECT max(tid) AS top FROM t),
c AS (SELECT tid, k, unnest(range(1, 2 + ({draw("pick", "tid")} < 0.5e0)::INT)) AS n FROM t),
u AS (SELECT *, {draw("method", "tid", "n")} AS m, {draw("factor", "tid", "n")} AS f FROM c)
SELECT tid, tid::VARCHAR AS oid, k::INT AS n_points FROM t
UNION ALL SELECT tid + n * (top + 1), tid || '_aug', CASE WHEN m < 0.4e0 THEN k WHEN m < 0.6000000000000001e0 THEN (k - 1) * CASE WHEN f < 0.5e0 THEN 2 ELSE 3 END + 1 WHEN m < 0.78e0 THEN k
  WHEN m < 0.9e0 AND k < 10 THEN (k - 1) * ceil(10e0 / k)::INT + 1 ELSE k END::INT FROM u, top""",
    "gen_queries": f"WITH {events(3, 'allp')}, c AS (SELECT * FROM allp ORDER BY {draw('centre', 'tid', 'seq')}, tid, seq LIMIT 100), {around('c', (5, 10, 20))}",
    "gen_queries_skewed": f"""WITH {events(3, "allp")}, b AS (SELECT *, least(9, floor(x / {W} * 10))::INT AS gx, least(9, floor(y / {H} * 10))::INT AS gy FROM allp),
g AS (SELECT gx, gy, count(*) AS n FROM b WHERE x BETWEEN 0 AND 720 AND y BETWEEN 0 AND 600 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, gx, gy) AS rn, count(*) OVER () AS total FROM g), h AS (SELECT gx, gy FROM r WHERE rn <= greatest(1, floor(0.2e0 * total))),
c AS (SELECT tid, seq, x, y FROM (SELECT b.* FROM b JOIN h USING (gx, gy) ORDER BY {draw("hot", "tid", "seq")}, tid, seq LIMIT 80) UNION ALL SELECT tid, seq, x, y FROM (SELECT * FROM allp ORDER BY {draw("all", "tid", "seq")}, tid, seq LIMIT 20)), {around("c", (5, 10, 20))}""",
    "gen_queries_meters": f"""WITH {events(3, "allp")}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM allp),
n AS (SELECT tid, seq, 115e0 + (x - x0) / (x1 - x0) * 3e0 AS x, 39e0 + (y - y0) / (y1 - y0) * 2.5e0 AS y FROM allp, e),
c AS (SELECT * FROM n ORDER BY {draw("centre", "tid", "seq")}, tid, seq LIMIT 100), {around("c", (100, 500, 2500), True)}""",
    "gen_queries_gaussian": f"""WITH r AS (SELECT range AS tid, 0 AS seq FROM range(200)),
c AS (SELECT tid, seq, least(118e0, greatest(115e0, 116.4e0 + 0.3e0 * {gauss("qx", "tid")})) AS x, least(41.5e0, greatest(39e0, 39.9e0 + 0.2e0 * {gauss("qy", "tid")})) AS y FROM r), {around("c", (100, 500, 2500), True)}""",
    "format_wkt": f"WITH {PTS} SELECT tid || ',' || tid || ',0,LINESTRING(' || string_agg(floor(x)::BIGINT || ' ' || floor(y)::BIGINT, ', ' ORDER BY seq) || ')' AS value FROM pts GROUP BY tid",
    "parse_queries": f"WITH {MBR} SELECT tid % 5 * 500 AS range_meters, count(*) AS n, sum(floor(min_x)) AS min_x, sum(floor(max_y)) AS max_y FROM mbr GROUP BY 1",
    "interpolate": f"""WITH {PTS}, s AS (SELECT tid, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY tid ORDER BY seq)), k AS (SELECT * FROM (VALUES (0), (1), (2)) AS v(j))
SELECT tid, (seq * 3 + j)::INT AS seq, round(x + CASE WHEN j = 0 THEN 0 ELSE j / 3e0 * (nx - x) END, 6) AS x, round(y + CASE WHEN j = 0 THEN 0 ELSE j / 3e0 * (ny - y) END, 6) AS y FROM s, k WHERE j = 0 OR nx IS NOT NULL""",
    "rotate": f"WITH {PTS}, {CENTRES} SELECT tid, seq, round((x - cx) * cos(radians(17e0)) - (y - cy) * sin(radians(17e0)) + cx, 6) AS x, round((x - cx) * sin(radians(17e0)) + (y - cy) * cos(radians(17e0)) + cy, 6) AS y FROM pts JOIN cc USING (tid)",
    "scale": f"""WITH {PTS}, {CENTRES}, z AS (SELECT tid, seq, cx + (x - cx) * 0.9e0 AS x, cy + (y - cy) * 0.9e0 AS y, CASE count(*) OVER (PARTITION BY tid) WHEN 2 THEN 5 ELSE 4 END AS f FROM pts JOIN cc USING (tid)),
s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM z WINDOW w AS (PARTITION BY tid ORDER BY seq)), k AS (SELECT unnest(range(5)) AS j)
SELECT tid, (seq * f + j)::INT AS seq, round(CASE WHEN j = 0 THEN x ELSE x + j / f::DOUBLE * (nx - x) END, 6) AS x, round(CASE WHEN j = 0 THEN y ELSE y + j / f::DOUBLE * (ny - y) END, 6) AS y FROM s, k WHERE j = 0 OR (j < f AND nx IS NOT NULL)""",
    "mix": f"""WITH {PTS} SELECT a.tid, a.seq, round(CASE WHEN b.x IS NULL THEN a.x ELSE a.x + 0.1e0 * (b.x - a.x) END, 6) AS x, round(CASE WHEN b.y IS NULL THEN a.y ELSE a.y + 0.1e0 * (b.y - a.y) END, 6) AS y
FROM pts a LEFT JOIN pts b ON b.tid = a.tid + 1 AND b.seq = a.seq WHERE a.tid + 1 IN (SELECT tid FROM pts)""",
    "meters_to_degrees": "SELECT event_id, round(500e0 / (111000e0 * cos(radians(value % 60))), 12) AS lon_deg, round(500e0 / 111000e0, 12) AS lat_deg FROM events",
    "split_queries": "WITH i AS (SELECT unnest(range(500)) AS query_id), r AS (SELECT query_id, (row_number() OVER (ORDER BY md5(query_id::VARCHAR), query_id) - 1) / count(*) OVER () AS p FROM i) SELECT query_id, CASE WHEN p < 0.7e0 THEN 'train' WHEN p < 0.7e0 + 0.15e0 THEN 'validation' ELSE 'test' END AS part FROM r",
}
ORACLE_SQL["read_part_files"] = ORACLE_SQL["parse_raw"]
