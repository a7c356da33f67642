"""Enrichment of labellings, centroids and orderings of zones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import colors
from ..operators import aggregates as A
from ..operators import bicluster as B
from ..operators import linear as L
from ..operators import windows as W
from ..operators.graph import nearest_chain
from .registry import EMB, emb_long, n, query, r, table

CROSS = """t AS (SELECT {a} AS a, {b} AS b FROM {src}), c AS (SELECT a, b, count(*) AS n FROM t GROUP BY a, b),
g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
p AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY b), 0) AS p, n / nullif(sum(n) OVER (PARTITION BY a), 0) AS q FROM g),
e AS (SELECT a, b, n, p / nullif(avg(p) OVER (PARTITION BY a), 0) * (q / nullif(avg(q) OVER (PARTITION BY b), 0)) AS enrichment FROM p)"""
DOCS = CROSS.format(a="lang", b="source", src="documents")


@query(f"WITH {DOCS} SELECT a AS lang, b AS source, CAST(n AS BIGINT) AS n, round(enrichment, 6) AS enrichment FROM e")
def zone_enrichment(spark, sf_dir):
    t = A.crosstab(table(spark, sf_dir, "documents"), "lang", "source")
    return A.enrichment(t, "lang", "source").select("lang", "source", n("n"), r("enrichment"))


@query(f"""WITH {DOCS}, m AS (SELECT b, coalesce(string_agg(CASE WHEN enrichment > 1.2 THEN a END, '-' ORDER BY a), 'Broad') AS name FROM e GROUP BY b),
k AS (SELECT b, name, row_number() OVER (PARTITION BY name ORDER BY b) - 1 AS k FROM m)
SELECT b AS source, name, CASE WHEN k > 0 THEN name || '_' || k ELSE name END AS unique_name FROM k""")
def zone_names(spark, sf_dir):
    t = A.enrichment(A.crosstab(table(spark, sf_dir, "documents"), "lang", "source"), "lang", "source")
    return W.number_later_repeats(A.enriched_names(t, "lang", "source", 1.2), "name", "source").select("source", "name", "unique_name")


@query("WITH " + CROSS.format(a="o_orderstatus", b="o_orderpriority", src="orders") + """, z AS (SELECT a, b, n, CASE WHEN n < 20 THEN 0.0 ELSE enrichment END AS enrichment, sum(n) OVER (PARTITION BY a) AS sa, sum(n) OVER (PARTITION BY b) AS sb FROM e)
SELECT a AS o_orderstatus, b AS o_orderpriority, CAST(n AS BIGINT) AS n, round(enrichment, 6) AS enrichment FROM z WHERE sa > 200 AND sb > 200""")
def parcellation_compare(spark, sf_dir):
    return A.compare_parcellations(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", n("n"), r("enrichment"))


@query("WITH " + CROSS.format(a="p_type", b="l_returnflag", src="lineitem JOIN part ON l_partkey = p_partkey") + " SELECT a AS p_type, b AS l_returnflag, CAST(n AS BIGINT) AS n, round(enrichment, 6) AS enrichment FROM e")
def type_flag_enrichment(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.enrichment(A.crosstab(j, "p_type", "l_returnflag"), "p_type", "l_returnflag").select("p_type", "l_returnflag", n("n"), r("enrichment"))


@query("WITH " + CROSS.format(a="o_orderpriority", b="o_orderstatus", src="orders") + " SELECT a AS o_orderpriority, b AS o_orderstatus, round(p, 6) AS fraction FROM p")
def leiden_zone_fraction(spark, sf_dir):
    t = A.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return A.fractions(t, "o_orderpriority", "o_orderstatus").select("o_orderpriority", "o_orderstatus", r("fraction"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), big AS (SELECT p_brand FROM c GROUP BY 1 HAVING sum(n) > 60), k AS (SELECT * FROM c WHERE p_brand IN (SELECT p_brand FROM big)),
g AS (SELECT x.p_brand, y.p_type, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT p_brand FROM k) x CROSS JOIN (SELECT DISTINCT p_type FROM k) y LEFT JOIN k ON k.p_brand = x.p_brand AND k.p_type = y.p_type)
SELECT p_brand, p_type, CAST(n AS BIGINT) AS n FROM g""")
def supported_crosstab(spark, sf_dir):
    return A.crosstab(table(spark, sf_dir, "part"), "p_brand", "p_type", 60, 0).select("p_brand", "p_type", n("n"))


@query(f"WITH {EMB} SELECT zone, feature_id, round(avg(value), 6) AS mean FROM emb GROUP BY 1, 2")
def zone_centroids(spark, sf_dir):
    return A.centroids(emb_long(spark, sf_dir), "zone").select("zone", "feature_id", r("mean"))


@query(f"""WITH {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2)
SELECT x.zone AS a, y.zone AS b, round(sqrt(sum((x.v - y.v) * (x.v - y.v))), 6) AS l2, round(1 - sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))), 6) AS cosine, round(1 - sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))), 6) AS union_cosine
FROM m x JOIN m y ON x.feature_id = y.feature_id AND x.zone < y.zone GROUP BY 1, 2""")
def centroid_distance(spark, sf_dir):
    d = L.centroid_distances(A.centroids(emb_long(spark, sf_dir), "zone"), "zone")
    return d.select("a", "b", r("l2"), r("cosine"), r("union_cosine"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT DISTINCT source FROM c), l AS (SELECT DISTINCT lang FROM c),
g AS (SELECT source, lang, CASE WHEN coalesce(n, 0) > 8 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS v FROM s CROSS JOIN l LEFT JOIN c USING (source, lang)),
j AS (SELECT x.source AS a, y.source AS b, sum(x.v * y.v) AS xy, sum(x.v * x.v) AS xx, sum(y.v * y.v) AS yy FROM g x JOIN g y ON x.lang = y.lang AND x.source < y.source GROUP BY 1, 2)
SELECT a, b, round(CASE WHEN xx = 0 AND yy = 0 THEN 0.0 WHEN xx = 0 OR yy = 0 THEN 1.0 ELSE 1 - xy / (sqrt(xx) * sqrt(yy)) END, 6) AS union_cosine FROM j""")
def cosine_union_support(spark, sf_dir):
    t = A.crosstab(table(spark, sf_dir, "documents"), "lang", "source").withColumn("v", F.when(F.col("n") > 8, F.col("n").cast("double")).otherwise(0.0))
    return L.centroid_distances(t, "source", "lang", "v").select("a", "b", r("union_cosine"))


@query(f"""WITH {EMB}, s AS (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM emb GROUP BY 1)
SELECT zone, emb.feature_id AS feature_id, round(avg(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END), 6) AS mean FROM emb JOIN s ON s.feature_id = emb.feature_id GROUP BY 1, 2""")
def minmax_zone_mean(spark, sf_dir):
    return A.min_max_zone_mean(emb_long(spark, sf_dir), "zone", "feature_id", "value").select("zone", "feature_id", r("mean"))


@query(f"""WITH {EMB}, f AS (SELECT zone, feature_id, avg(CASE WHEN value > 0.0 THEN 1.0 ELSE 0.0 END) AS f FROM emb GROUP BY 1, 2) SELECT zone, CAST(count(*) FILTER (f > 0.5) AS BIGINT) AS features FROM f GROUP BY 1""")
def prevalence_per_zone(spark, sf_dir):
    return A.prevalence(emb_long(spark, sf_dir), "zone", share=0.5, least=0.0).select("zone", n("features"))


@query("SELECT CAST(label AS BIGINT) AS zone, CAST(count(*) AS BIGINT) AS pixels FROM embeddings GROUP BY 1")
def pixels_per_zone(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("zone")).agg(F.count("*").alias("pixels"))


@query(f"""WITH {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2), s AS (SELECT feature_id, zone, v, row_number() OVER (PARTITION BY feature_id ORDER BY abs(v) DESC, zone) AS place, sum(abs(v)) OVER (PARTITION BY feature_id ORDER BY abs(v) DESC, zone ROWS UNBOUNDED PRECEDING) / nullif(sum(abs(v)) OVER (PARTITION BY feature_id), 0) AS share FROM m)
SELECT feature_id, zone, CAST(place AS BIGINT) AS place, round(share, 6) AS share FROM s""")
def cumulative_share(spark, sf_dir):
    c = A.centroids(emb_long(spark, sf_dir), "zone")
    return W.cumulative_share(c, "feature_id", "mean", "zone").select("feature_id", "zone", n("place"), r("share"))


@query(f"""WITH {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2), s AS (SELECT feature_id, zone, v, row_number() OVER (PARTITION BY feature_id ORDER BY abs(v) DESC, zone) AS place, sum(abs(v)) OVER (PARTITION BY feature_id ORDER BY abs(v) DESC, zone ROWS UNBOUNDED PRECEDING) / nullif(sum(abs(v)) OVER (PARTITION BY feature_id), 0) AS share FROM m),
w AS (SELECT feature_id, place, share, max(place) OVER (PARTITION BY feature_id) AS n, min(share) OVER (PARTITION BY feature_id) AS lo, max(share) OVER (PARTITION BY feature_id) AS hi FROM s),
h AS (SELECT feature_id, place, row_number() OVER (PARTITION BY feature_id ORDER BY round(share - (lo + (hi - lo) * (place - 1) / nullif(n - 1, 0)), 9) DESC, place) AS k FROM w)
SELECT feature_id, CAST(place AS BIGINT) AS knee FROM h WHERE k = 1""")
def share_knee(spark, sf_dir):
    c = A.centroids(emb_long(spark, sf_dir), "zone")
    return W.knee(W.cumulative_share(c, "feature_id", "mean", "zone"), "feature_id").select("feature_id", n("knee"))


@query(f"""WITH {EMB}, m AS (SELECT zone, avg(value) FILTER (feature_id = 0) AS u, avg(value) FILTER (feature_id = 1) AS v FROM emb GROUP BY 1),
d AS (SELECT zone, coalesce(sqrt((u - lag(u) OVER (ORDER BY zone)) * (u - lag(u) OVER (ORDER BY zone)) + (v - lag(v) OVER (ORDER BY zone)) * (v - lag(v) OVER (ORDER BY zone))), 0.0) AS step FROM m),
c AS (SELECT zone, sum(step) OVER (ORDER BY zone ROWS UNBOUNDED PRECEDING) AS s FROM d) SELECT zone, round(coalesce(s / nullif(max(s) OVER (), 0), 0.0), 6) AS axis FROM c""")
def adjacent_distance_axis(spark, sf_dir):
    m = emb_long(spark, sf_dir).groupBy("zone").agg(F.avg(F.when(F.col("feature_id") == 0, F.col("value"))).alias("u"), F.avg(F.when(F.col("feature_id") == 1, F.col("value"))).alias("v"))
    return W.adjacent_axis(m, "zone", "u", "v").select("zone", r("axis"))


@query(f"""WITH RECURSIVE {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2), d AS (SELECT x.zone AS a, y.zone AS b, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM m x JOIN m y ON x.feature_id = y.feature_id AND x.zone <> y.zone GROUP BY 1, 2),
w(step, zone, seen, total) AS (SELECT 0, min(zone), [min(zone)], CAST(0 AS DOUBLE) FROM m UNION ALL SELECT step + 1, b, list_append(seen, b), total + d FROM (SELECT w.step, w.seen, w.total, d.b, d.d, row_number() OVER (ORDER BY d.d, d.b) AS k FROM w JOIN d ON d.a = w.zone AND NOT list_contains(w.seen, d.b)) WHERE k = 1)
SELECT CAST(step AS BIGINT) AS step, zone, round(total, 6) AS distance FROM w""")
def nn_chain(spark, sf_dir):
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone")  # zones x features
    order, so_far = nearest_chain(m.to_numpy())
    rows = [(i, int(m.index[z]), float(d)) for i, (z, d) in enumerate(zip(order, so_far))]
    return spark.createDataFrame(rows, "step long, zone long, distance double").select("step", "zone", r("distance"))


@query(f"""WITH {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2), b AS (SELECT zone, feature_id AS peak, row_number() OVER (PARTITION BY zone ORDER BY v DESC, feature_id) AS k FROM m)
SELECT zone, peak, CAST(row_number() OVER (ORDER BY peak, zone) AS BIGINT) AS place FROM b WHERE k = 1""")
def heatmap_row_order(spark, sf_dir):
    return W.row_order_by_peak(A.centroids(emb_long(spark, sf_dir), "zone"), "zone", "feature_id", "mean").select("zone", "peak", n("place"))


@query()
def zone_linkage(spark, sf_dir):
    """Merges of zones (WPGMA on cosine distances) and the leaf order."""
    d = L.centroid_distances(A.centroids(emb_long(spark, sf_dir), "zone"), "zone").toPandas()
    zones = sorted({*d["a"], *d["b"]})
    at = {z: i for i, z in enumerate(zones)}
    m = np.zeros((len(zones), len(zones)))
    for a, b, v in zip(d["a"], d["b"], d["cosine"]):
        m[at[a], at[b]] = m[at[b], at[a]] = v
    order = L.leaf_order(L.linkage(m), m)
    return spark.createDataFrame([(i, int(zones[z])) for i, z in enumerate(order)], "place long, zone long")


@query()
def zone_seriation(spark, sf_dir):
    """Zones in seriated order, and the two groups of the best break."""
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone")
    order = B.spin(m.to_numpy(), 0.6, columns=False)[0]
    corr = B.correlation(m.to_numpy())
    at = B.best_break(corr[np.ix_(order, order)])
    return spark.createDataFrame([(i, int(m.index[z]), int(at is not None and i >= at)) for i, z in enumerate(order)], "place long, zone long, part long")


@query()
def zone_components(spark, sf_dir):
    """Three principal components of standardised zone centroids."""
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone")
    s = np.round(L.principal_components(m.to_numpy()), 6)
    return spark.createDataFrame([(int(z), *map(float, row)) for z, row in zip(m.index, s)], "zone long, pc1 double, pc2 double, pc3 double")


@query(f"""WITH {EMB}, m AS (SELECT zone, feature_id, avg(value) AS v FROM emb GROUP BY 1, 2), j AS (SELECT x.zone AS a, y.zone AS b, x.v AS x, y.v AS y FROM m x JOIN m y ON x.feature_id = y.feature_id AND x.zone < y.zone)
SELECT a, b, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS r FROM j GROUP BY 1, 2""")
def zone_correlation(spark, sf_dir):
    c = A.centroids(emb_long(spark, sf_dir), "zone")
    j = c.select(F.col("zone").alias("a"), "feature_id", F.col("mean").alias("x")).join(c.select(F.col("zone").alias("b"), "feature_id", F.col("mean").alias("y")), "feature_id").where("a < b")
    return j.groupBy("a", "b").agg((F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0))).alias("r")).select("a", "b", r("r"))


@query(f"""WITH {EMB}, m AS (SELECT zone, round(255 * avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) FILTER (feature_id = 0)) AS r, round(255 * avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) FILTER (feature_id = 1)) AS g, round(255 * avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) FILTER (feature_id = 2)) AS b FROM emb GROUP BY 1)
SELECT zone, printf('#%02x%02x%02x', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS color, CAST(r AS BIGINT) AS red FROM m""")
def zone_colors(spark, sf_dir):
    share = lambda f: F.round(255 * F.avg(F.when(F.col("feature_id") == f, (F.col("value") > 0).cast("double"))))
    m = emb_long(spark, sf_dir).groupBy("zone").agg(share(0).alias("r"), share(1).alias("g"), share(2).alias("b"))
    c = m.select("zone", colors.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"))
    return c.withColumn("red", colors.hex_part(F.col("color"), 0).cast("long"))
