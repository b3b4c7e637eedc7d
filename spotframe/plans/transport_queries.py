"""Distance-limited LR transport, pathway sums and direction fields.

Driver parameters (FIXTURES.md): coarse counts, radius 250 (self pair included),
eps 0.1, lambda 1, 5 Sinkhorn iterations, 5 strongest partners, grid cell 500.
Flows are reported in parts per million of the normalised totals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import slide as sp
from spotframe.operators import transport as tr
from spotframe.plans.catalog import finish, register
from spotframe.plans.lr_queries import LR_BASE, LRFlow
from spotframe.plans.oracle_views import with_views
from spotframe.session import stage

RADIUS = 250.0
EPS = 0.1
LAM = 1.0
ITERS = 5
TOP_K = 5
CELL = 500.0
RHO = LAM / (LAM + EPS)
V = ["spots", "expr_coarse", "lr_db"]


def _flow(spark, d):
    f = LRFlow(spark, d)
    pairs = stage(sp.spot_pairs_within(f.spots, RADIUS, include_self=True))
    return f, tr.lr_transport(f.ce(), pairs, RADIUS, EPS, LAM, ITERS, spots=f.spots)


def _sinkhorn_sql() -> str:
    s = LR_BASE + f""",
pr AS (SELECT a.sample, a.barcode AS src, b.barcode AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
       FROM spots a JOIN spots b ON a.sample = b.sample WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {RADIUS}),
aa AS (SELECT sample, lr, barcode AS src, value / sum(value) OVER (PARTITION BY sample, lr) AS a FROM ce WHERE side = 'L'),
bb AS (SELECT sample, lr, barcode AS dst, value / sum(value) OVER (PARTITION BY sample, lr) AS b FROM ce WHERE side = 'R'),
e AS (SELECT p.sample, a.lr, p.src, p.dst, exp(-pow(p.d / {RADIUS}, 2) / {EPS}) AS k, a.a, b.b
      FROM pr p JOIN aa a ON a.sample = p.sample AND a.src = p.src
      JOIN bb b ON b.sample = p.sample AND b.lr = a.lr AND b.dst = p.dst),
v0 AS (SELECT DISTINCT sample, lr, dst, 1.0::DOUBLE AS v FROM e)"""
    for i in range(1, ITERS + 1):
        s += f""",
u{i} AS (SELECT e.sample, e.lr, e.src, pow(max(e.a) / sum(e.k * v.v), {RHO!r}) AS u
        FROM e JOIN v{i - 1} v USING (sample, lr, dst) GROUP BY 1, 2, 3),
v{i} AS (SELECT e.sample, e.lr, e.dst, pow(max(e.b) / sum(e.k * u.u), {RHO!r}) AS v
        FROM e JOIN u{i} u USING (sample, lr, src) GROUP BY 1, 2, 3)"""
    s += f""",
flow AS (SELECT e.sample, e.lr, e.src, e.dst, u.u * e.k * v.v AS flow
         FROM e JOIN u{ITERS} u USING (sample, lr, src) JOIN v{ITERS} v USING (sample, lr, dst)),
amt AS (SELECT coalesce(s.sample, r.sample) AS sample, coalesce(s.lr, r.lr) AS lr, coalesce(s.barcode, r.barcode) AS barcode,
               coalesce(s.sent, 0.0) AS sent, coalesce(r.received, 0.0) AS received
        FROM (SELECT sample, lr, src AS barcode, sum(flow) AS sent FROM flow GROUP BY 1, 2, 3) s
        FULL JOIN (SELECT sample, lr, dst AS barcode, sum(flow) AS received FROM flow GROUP BY 1, 2, 3) r
        ON s.sample = r.sample AND s.lr = r.lr AND s.barcode = r.barcode)"""
    return s


SINK_SQL = _sinkhorn_sql()


@register("lr_transport", with_views(SINK_SQL + """
SELECT sample, lr, src, dst, round(flow * 1e6, 6) AS flow_ppm FROM flow""", V))
def lr_transport(spark, d):
    """H13 -> C11 -> H14: unbalanced Sinkhorn flow per LR between spots within distance 250."""
    _, flow = _flow(spark, d)
    return finish(flow.select("sample", "lr", "src", "dst", (F.col("flow") * F.lit(1e6)).alias("flow_ppm")))


@register("pathway_sum", with_views(SINK_SQL + """
SELECT a.sample, a.barcode, d.pathway, round(sum(a.sent) * 1e6, 6) AS sent_ppm, round(sum(a.received) * 1e6, 6) AS received_ppm
FROM amt a JOIN lr_db d USING (lr) GROUP BY ROLLUP (a.sample, a.barcode, d.pathway) HAVING a.barcode IS NOT NULL""", V))
def pathway_sum(spark, d):
    """Sent / received per pathway and spot, with the all-pathway total (pathway NULL)."""
    f, flow = _flow(spark, d)
    p = tr.pathway_sum(tr.spot_amounts(stage(flow)), f.lr_db)
    return finish(p.select("sample", "barcode", "pathway", (F.col("sent") * F.lit(1e6)).alias("sent_ppm"),
                           (F.col("received") * F.lit(1e6)).alias("received_ppm")))


_FIELD_SQL = SINK_SQL + f""",
fp AS (SELECT f.*, a.x AS xs, a.y AS ys, b.x AS xd, b.y AS yd FROM flow f
       JOIN spots a ON a.sample = f.sample AND a.barcode = f.src JOIN spots b ON b.sample = f.sample AND b.barcode = f.dst),
snd AS (SELECT sample, lr, src AS barcode, dst AS other, flow, (xd - xs) / sqrt((xd - xs) * (xd - xs) + (yd - ys) * (yd - ys)) AS ux,
               (yd - ys) / sqrt((xd - xs) * (xd - xs) + (yd - ys) * (yd - ys)) AS uy, 'sender' AS direction
        FROM fp WHERE sqrt((xd - xs) * (xd - xs) + (yd - ys) * (yd - ys)) > 0),
rcv AS (SELECT sample, lr, dst AS barcode, src AS other, flow, -1.0 * (xs - xd) / sqrt((xs - xd) * (xs - xd) + (ys - yd) * (ys - yd)) AS ux,
               -1.0 * (ys - yd) / sqrt((xs - xd) * (xs - xd) + (ys - yd) * (ys - yd)) AS uy, 'receiver' AS direction
        FROM fp WHERE sqrt((xs - xd) * (xs - xd) + (ys - yd) * (ys - yd)) > 0),
both_ AS (SELECT * FROM snd UNION ALL SELECT * FROM rcv),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, lr, barcode, direction ORDER BY flow DESC, other) AS r
                       FROM both_) WHERE r <= {TOP_K}),
vec AS (SELECT sample, lr, barcode, direction, sum(flow * ux) AS vx, sum(flow * uy) AS vy FROM top GROUP BY 1, 2, 3, 4),
tot AS (SELECT sample, lr, src AS barcode, 'sender' AS direction, sum(flow) AS total FROM flow GROUP BY 1, 2, 3
        UNION ALL SELECT sample, lr, dst, 'receiver', sum(flow) FROM flow GROUP BY 1, 2, 3),
field AS (SELECT v.sample, v.lr, v.barcode, v.direction,
                 CASE WHEN sqrt(vx * vx + vy * vy) > 0 THEN vx / sqrt(vx * vx + vy * vy) * t.total ELSE 0.0 END AS vx,
                 CASE WHEN sqrt(vx * vx + vy * vy) > 0 THEN vy / sqrt(vx * vx + vy * vy) * t.total ELSE 0.0 END AS vy
          FROM vec v JOIN tot t USING (sample, lr, barcode, direction))"""


@register("direction_field", with_views(_FIELD_SQL + """
SELECT sample, lr, barcode, direction, round(vx * 1e6, 6) AS vx_ppm, round(vy * 1e6, 6) AS vy_ppm FROM field""", V))
def direction_field(spark, d):
    """Sender / receiver direction vectors toward the 5 strongest partners."""
    f, flow = _flow(spark, d)
    fld = tr.direction_field(flow, f.spots, TOP_K)
    return finish(fld.select("sample", "lr", "barcode", "direction", (F.col("vx") * F.lit(1e6)).alias("vx_ppm"),
                             (F.col("vy") * F.lit(1e6)).alias("vy_ppm")))


_PATHWAY_SQL = SINK_SQL + """,
pflow AS (SELECT f.sample, d.pathway, f.src, f.dst, sum(f.flow) AS flow FROM flow f JOIN lr_db d USING (lr) GROUP BY 1, 2, 3, 4)"""


@register("pathway_flow", with_views(_PATHWAY_SQL + """
SELECT sample, pathway, src, dst, round(flow * 1e6, 6) AS flow_ppm FROM pflow""", V))
def pathway_flow(spark, d):
    """Flow per pathway and spot pair."""
    f, flow = _flow(spark, d)
    p = tr.pathway_flow(flow, f.lr_db)
    return finish(p.select("sample", "pathway", "src", "dst", (F.col("flow") * F.lit(1e6)).alias("flow_ppm")))


@register("direction_field_pathway", with_views(_PATHWAY_SQL + f""",
fp AS (SELECT f.*, a.x AS xs, a.y AS ys, b.x AS xd, b.y AS yd FROM pflow f
       JOIN spots a ON a.sample = f.sample AND a.barcode = f.src JOIN spots b ON b.sample = f.sample AND b.barcode = f.dst),
dd AS (SELECT *, sqrt((xd - xs) * (xd - xs) + (yd - ys) * (yd - ys)) AS dist FROM fp),
ends AS (SELECT sample, pathway, src AS barcode, dst AS other, flow, (xd - xs) / dist AS ux, (yd - ys) / dist AS uy, 'sender' AS direction
         FROM dd WHERE dist > 0
         UNION ALL SELECT sample, pathway, dst, src, flow, (xd - xs) / dist, (yd - ys) / dist, 'receiver' FROM dd WHERE dist > 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, pathway, barcode, direction ORDER BY flow DESC, other) AS r
                       FROM ends) WHERE r <= {TOP_K}),
vec AS (SELECT sample, pathway, barcode, direction, sum(flow * ux) AS vx, sum(flow * uy) AS vy FROM top GROUP BY 1, 2, 3, 4),
tot AS (SELECT sample, pathway, src AS barcode, 'sender' AS direction, sum(flow) AS total FROM pflow GROUP BY 1, 2, 3
        UNION ALL SELECT sample, pathway, dst, 'receiver', sum(flow) FROM pflow GROUP BY 1, 2, 3)
SELECT v.sample, v.pathway, v.barcode, v.direction,
       round(CASE WHEN sqrt(vx * vx + vy * vy) > 0 THEN vx / sqrt(vx * vx + vy * vy) * t.total ELSE 0.0 END * 1e6, 6) AS vx_ppm,
       round(CASE WHEN sqrt(vx * vx + vy * vy) > 0 THEN vy / sqrt(vx * vx + vy * vy) * t.total ELSE 0.0 END * 1e6, 6) AS vy_ppm
FROM vec v JOIN tot t USING (sample, pathway, barcode, direction)""", V))
def direction_field_pathway(spark, d):
    """H15 -> H16: sender / receiver direction vectors of every pathway's flow."""
    f, flow = _flow(spark, d)
    fld = tr.direction_field(tr.pathway_flow(flow, f.lr_db), f.spots, TOP_K, key="pathway")
    return finish(fld.select("sample", "pathway", "barcode", "direction", (F.col("vx") * F.lit(1e6)).alias("vx_ppm"),
                             (F.col("vy") * F.lit(1e6)).alias("vy_ppm")))


@register("direction_grid", with_views(_FIELD_SQL + f""",
g AS (SELECT f.sample, f.lr, f.direction, floor(s.x / {CELL}) AS gx, floor(s.y / {CELL}) AS gy,
             avg(f.vx) AS vx, avg(f.vy) AS vy FROM field f JOIN spots s USING (sample, barcode) GROUP BY 1, 2, 3, 4, 5),
g2 AS (SELECT *, sqrt(vx * vx + vy * vy) AS len FROM g),
q AS (SELECT sample, lr, direction, quantile_cont(len, 0.995) AS q FROM g2 GROUP BY 1, 2, 3)
SELECT g2.sample, g2.lr, g2.direction, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy,
       round(vx * CASE WHEN len > q THEN q / len ELSE 1.0 END * 1e6, 6) AS vx_ppm,
       round(vy * CASE WHEN len > q THEN q / len ELSE 1.0 END * 1e6, 6) AS vy_ppm
FROM g2 JOIN q USING (sample, lr, direction)""", V))
def direction_grid(spark, d):
    """Grid-smoothed direction vectors (cell 500) with lengths clipped at the 0.995 quantile."""
    f, flow = _flow(spark, d)
    grid = tr.direction_grid(tr.direction_field(flow, f.spots, TOP_K), f.spots, CELL)
    return finish(grid.select("sample", "lr", "direction", "gx", "gy", (F.col("vx") * F.lit(1e6)).alias("vx_ppm"),
                              (F.col("vy") * F.lit(1e6)).alias("vy_ppm")))
