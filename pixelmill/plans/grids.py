"""Spatial queries on the lattice of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as X
from ..operators import spatial as S
from ..operators import surface as V
from .registry import LAT, OFF4, OFF8, lattice, n, query, r

MORAN = f"""WITH {LAT}, {OFF4}, lf AS (SELECT x, y, 'price' AS f, price AS v FROM lat UNION ALL SELECT x, y, 'size', CAST(size AS DOUBLE) FROM lat), z AS (SELECT x, y, f, v - avg(v) OVER (PARTITION BY f) AS z FROM lf),
l AS (SELECT a.f, a.x, a.y, avg(b.z) AS lag FROM z a, off4 JOIN z b ON b.f = a.f AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY 1, 2, 3)
SELECT z.f AS feature_id, round(coalesce(count(*) / nullif(count(lag), 0) * (sum(z * lag) / nullif(sum(z * z), 0)), 0.0), 6) AS moran_i FROM z LEFT JOIN l ON l.f = z.f AND l.x = z.x AND l.y = z.y GROUP BY 1"""


@query(MORAN)
def moran_by_feature(spark, sf_dir):
    lat = lattice(spark, sf_dir)
    long = lat.select("section_id", "x", "y", F.lit("price").alias("feature_id"), F.col("price").alias("value")).unionByName(lat.select("section_id", "x", "y", F.lit("size").alias("feature_id"), F.col("size").cast("double").alias("value")))
    return S.moran(long).select("feature_id", r("moran_i"))


@query(f"""WITH {LAT}, {OFF8}, p AS (SELECT a.label AS label, b.label AS nb_label, count(*) AS n FROM lat a, off8 JOIN lat b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY 1, 2) SELECT label, nb_label, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM p""")
def neighbor_label_props(spark, sf_dir):
    return S.neighbourhood(lattice(spark, sf_dir)).select("label", "nb_label", n("n"), r("share"))


@query(f"WITH {LAT}, s AS (SELECT x, y FROM lat) SELECT a.x AS x, a.y AS y, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM s a JOIN s b ON a.x <> b.x OR a.y <> b.y GROUP BY 1, 2")
def nearest_neighbor_distance(spark, sf_dir):
    return S.nearest_distance(lattice(spark, sf_dir)).select("x", "y", r("distance"))


@query(f"WITH {LAT} SELECT CAST(floor(x / 5) AS BIGINT) AS i, CAST(floor(y / 5) AS BIGINT) AS j, CAST(size % 3 AS BIGINT) AS k, round(avg(CASE WHEN price > 0 THEN ln(price) END), 6) AS mean FROM lat GROUP BY 1, 2, 3")
def voxel_mean(spark, sf_dir):
    return A.voxel_mean(lattice(spark, sf_dir), F.col("x") / 5, F.col("y") / 5, F.col("size") % 3, F.col("price")).select(n("i"), n("j"), n("k"), r("mean"))


@query(f"WITH {LAT} SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS i, CAST(floor(y / 4) AS BIGINT) AS j, CAST(size % 5 AS BIGINT) AS k FROM lat WHERE floor(x / 4) < 10 AND floor(y / 4) < 8 AND size % 5 < 4")
def occupied_voxels(spark, sf_dir):
    return S.voxels(lattice(spark, sf_dir), F.col("x") / 4, F.col("y") / 4, F.col("size") % 5, (10, 8, 4)).select(n("i"), n("j"), n("k"))


@query(f"WITH {LAT} SELECT CAST(x // 2 AS BIGINT) AS col, CAST(y // 2 AS BIGINT) AS row, round(price, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY x // 2, y // 2 ORDER BY part_id DESC) AS k FROM lat) WHERE k = 1")
def raster_2d(spark, sf_dir):
    p = lattice(spark, sf_dir).withColumns({"hx": F.floor(F.col("x") / 2), "hy": F.floor(F.col("y") / 2)})
    return S.raster(p, "section_id", "hx", "hy", "price", "part_id").select(n("col"), n("row"), r("price", 2))


@query(f"""WITH {LAT}, {OFF4}, q AS (SELECT x, y, CASE WHEN size % 4 = 0 THEN 'a' ELSE 'b' END AS label FROM lat), s AS (SELECT a.x, a.y FROM q a, off4 JOIN q b ON b.x = a.x + dx AND b.y = a.y + dy AND b.label = a.label GROUP BY 1, 2 HAVING count(*) = 4)
SELECT x, y, label FROM q WHERE (x, y) NOT IN (SELECT (x, y) FROM s)""")
def border_cells(spark, sf_dir):
    q = lattice(spark, sf_dir).select("section_id", "x", "y", F.when(F.col("size") % 4 == 0, "a").otherwise("b").alias("label"))
    return S.border(q, "section_id", "x", "y", "label").select("x", "y", "label")


@query(f"WITH {LAT} SELECT part_id, printf('section%d_pixel%d_%d', section_id, x, y) AS barcode FROM lat")
def barcode(spark, sf_dir):
    return X.add_barcodes(lattice(spark, sf_dir)).select("part_id", "barcode")


@query(f"WITH {LAT} SELECT part_id FROM lat WHERE label IN ('STANDARD', 'PROMO') AND x BETWEEN 5 AND 30 AND y BETWEEN 2 AND 20")
def multi_crop(spark, sf_dir):
    return X.crop(lattice(spark, sf_dir), {"label": ["STANDARD", "PROMO"]}, {"x": (5, 30), "y": (2, 20)}).select("part_id")


@query(f"WITH {LAT} SELECT part_id FROM lat WHERE y < (SELECT avg(y) FROM lat)")
def half_section(spark, sf_dir):
    return X.half_section(lattice(spark, sf_dir)).select("part_id")


@query(f"""WITH {LAT}, e AS (SELECT min(price) AS lo, max(price) AS hi, quantile_cont(price, 0.1) AS q FROM lat) SELECT part_id, round(CASE WHEN price <= q THEN 0.0 ELSE coalesce((price - lo) * 255 / nullif(hi - lo, 0), 0.0) END, 4) AS scaled FROM lat, e""")
def scaled_to_255(spark, sf_dir):
    return S.to_255(lattice(spark, sf_dir), "price").select("part_id", r("scaled", 4))


@query(f"""WITH RECURSIVE {LAT}, st AS (SELECT x, y, md5(concat_ws(':', 42, section_id, x, y)) AS h, 0 AS state FROM lat
UNION ALL (WITH u AS (SELECT x, y, h FROM st WHERE state = 0), o AS (SELECT dx, dy FROM range(-2, 3) AS a(dx), range(-2, 3) AS b(dy)),
l AS (SELECT u.x + dx AS x, u.y + dy AS y, min(h) AS least FROM u, o GROUP BY 1, 2), k AS (SELECT u.x, u.y, u.h FROM u JOIN l ON l.x = u.x AND l.y = u.y WHERE h = least),
g AS (SELECT DISTINCT k.x + dx AS x, k.y + dy AS y FROM k, o) SELECT x, y, h, 1 FROM k UNION ALL SELECT u.x, u.y, u.h, 0 FROM u ANTI JOIN g ON g.x = u.x AND g.y = u.y))
SELECT CAST(0 AS INTEGER) AS section_id, x, y FROM st WHERE state = 1""")
def spatial_thin(spark, sf_dir):
    return S.thin(lattice(spark, sf_dir))


@query(f"""WITH {LAT}, m AS (SELECT c.x, c.y, sum(k.price * exp(-sqrt((c.x - k.x) ** 2 + (c.y - k.y) ** 2))) / sum(exp(-sqrt((c.x - k.x) ** 2 + (c.y - k.y) ** 2))) AS mean
FROM lat c JOIN lat k ON k.part_id % 5 = 0 AND k.price >= 0 AND k.y BETWEEN c.y - 4 AND c.y + 4 AND (c.x - k.x) ** 2 + (c.y - k.y) ** 2 <= 16 GROUP BY 1, 2)
SELECT lat.x AS i, lat.y AS j, CAST(0 AS BIGINT) AS k, round(CASE WHEN part_id % 5 = 0 AND price >= 0 THEN price ELSE mean END, 4) AS value FROM lat LEFT JOIN m ON m.x = lat.x AND m.y = lat.y""")
def interpolate_volume(spark, sf_dir):
    lat = lattice(spark, sf_dir)
    cells = lat.select(F.col("x").alias("i"), F.col("y").alias("j"), (F.col("size") * 0).cast("long").alias("k"), F.lit("a").alias("region"), F.col("price").alias("value"), "part_id")
    known = cells.where("part_id % 5 = 0").select("i", "j", "k", "region", "value")
    return S.interpolate(cells.select("i", "j", "k", "region"), known, 4, first=0).select("i", "j", "k", r("value", 4))


@query(f"""WITH RECURSIVE {LAT}, {OFF8}, v AS (SELECT x, y FROM lat WHERE size % 3 = 0), e AS (SELECT v.x, v.y, w.x AS x2, w.y AS y2 FROM v, off8 JOIN v w ON w.x = v.x + dx AND w.y = v.y + dy),
reach AS (SELECT x, y, x AS cx, y AS cy FROM v UNION SELECT e.x2, e.y2, cx, cy FROM reach JOIN e ON e.x = reach.x AND e.y = reach.y)
SELECT x AS i, y AS j, min(cx) AS ci, arg_min(cy, cx * 1000000 + cy) AS cj FROM reach GROUP BY 1, 2""")
def mask_components(spark, sf_dir):
    lat = lattice(spark, sf_dir).where("size % 3 = 0")
    return S.components_3d(lat.select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(0).cast("long").alias("k"))).select("i", "j", F.col("component.i").alias("ci"), F.col("component.j").alias("cj"))


@query(f"""WITH {LAT}, v AS (SELECT x AS i, y AS j, 0 AS k, price AS p FROM lat), d AS (SELECT s AS step, s // 4 AS a, s // 2 % 2 AS b, s % 2 AS c FROM (SELECT unnest(range(1, 8)) AS s)),
e AS (SELECT v.i, v.j, v.k, step, a, b, c, p AS low, coalesce((SELECT max(w.p) FROM v w WHERE w.i = v.i + a AND w.j = v.j + b AND w.k = v.k + c), 0.0) AS high FROM v, d WHERE p > 1400
UNION SELECT v.i - a, v.j - b, v.k - c, step, a, b, c, coalesce((SELECT max(w.p) FROM v w WHERE w.i = v.i - a AND w.j = v.j - b AND w.k = v.k - c), 0.0), p FROM v, d WHERE p > 1400)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, CAST(step AS INTEGER) AS step, round(i + a * (1400 - low) / (high - low), 6) AS x, round(j + b * (1400 - low) / (high - low), 6) AS y, round(k + c * (1400 - low) / (high - low), 6) AS z
FROM e WHERE (low > 1400) <> (high > 1400)""")
def surface_vertices(spark, sf_dir):
    """Vertices of the surface around the dear parts of the lattice, one voxel high."""
    lat = lattice(spark, sf_dir).select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(0).alias("k"), F.col("price").alias("value"))
    return V.vertices(V.surface(lat, 1400.0)).select("i", "j", "k", "step", r("x"), r("y"), r("z"))
