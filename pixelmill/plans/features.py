"""Statistics of features over pixels and sections; selection, scaling, restoration, inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bicluster as B
from ..operators import cluster as C
from ..operators import communities as M
from ..operators import filters as X
from ..operators import graph as G
from ..operators import inference as I
from ..operators import layout as Y
from ..operators import linear as L
from ..operators import restore as R
from ..operators import windows as W
from .registry import EMB, emb_long, n, query, r, table

CORR = f"""{EMB}, j AS (SELECT x.feature_id AS src, y.feature_id AS dst, x.value AS x, y.value AS y FROM emb x JOIN emb y ON x.pixel_id = y.pixel_id AND x.feature_id < y.feature_id),
w AS (SELECT src, dst, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS weight FROM j GROUP BY 1, 2)"""
STATS = "SELECT feature_id, section_id, var_pop(value) AS v, avg(value) AS m FROM emb GROUP BY 1, 2"


@query(f"WITH {EMB}, s AS ({STATS}) SELECT feature_id, round(avg(v), 8) AS mean_of_variances, round(var_pop(v), 10) AS variance_of_variances, round(avg(v) - var_pop(v) / 2, 8) AS score FROM s GROUP BY 1")
def variance_of_variances(spark, sf_dir):
    return A.variance_of_variances(emb_long(spark, sf_dir)).select("feature_id", r("mean_of_variances", 8), r("variance_of_variances", 10), r("score", 8))


@query(f"""WITH {EMB}, s AS ({STATS}), f AS (SELECT feature_id, avg(v) AS m, var_pop(v) AS q FROM s GROUP BY 1), z AS (SELECT feature_id, m / nullif(avg(m) OVER (), 0) - q / nullif(avg(q) OVER (), 0) AS score FROM f)
SELECT feature_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, feature_id) AS BIGINT) AS place FROM z""")
def variance_rank_normalised(spark, sf_dir):
    return A.normalised_variance_rank(emb_long(spark, sf_dir)).select("feature_id", r("score"), n("place"))


@query("""WITH m AS (SELECT l_linenumber AS feature_id, l_suppkey % 8 AS section_id, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
SELECT CAST(feature_id AS BIGINT) AS feature_id, CAST(count(*) FILTER (m < 25.5) AS BIGINT) AS missing, count(*) FILTER (m < 25.5) < 4 AS kept FROM m GROUP BY 1""")
def section_dropout(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("feature_id"), (F.col("l_suppkey") % 8).alias("section_id"), F.col("l_quantity").alias("value"))
    return A.section_dropout(li, "feature_id", "section_id", "value", 25.5).select("feature_id", n("missing"), "kept")


@query(f"""WITH {EMB}, s AS ({STATS}), f AS (SELECT feature_id, avg(v) AS score, avg(abs(m)) AS moran FROM s GROUP BY 1), c AS (SELECT feature_id % 6 AS cluster, sqrt(avg(score) * avg(score) + 2 * avg(moran) * avg(moran)) AS gate FROM f GROUP BY 1)
SELECT cluster, round(gate, 8) AS gate, gate >= (SELECT quantile_cont(gate, 0.5) FROM c) AS kept FROM c""")
def cluster_gate(spark, sf_dir):
    s = emb_long(spark, sf_dir).groupBy("feature_id", "section_id").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"))
    f = s.groupBy("feature_id").agg(F.avg("v").alias("score"), F.avg(F.abs("m")).alias("moran")).withColumn("cluster", F.col("feature_id") % 6)
    return A.cluster_gate(f, "cluster", "score", "moran").select("cluster", r("gate", 8), "kept")


@query("""WITH s AS (SELECT l_linenumber AS feature_id, l_suppkey % 8 AS section_id, avg(CASE WHEN l_returnflag <> 'N' THEN exp(l_discount) ELSE 0.0 END * 1e6) AS m FROM lineitem GROUP BY 1, 2)
SELECT CAST(feature_id AS BIGINT) AS feature_id, round(sum(m), 2) AS signal FROM s GROUP BY 1""")
def total_signal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("feature_id"), (F.col("l_suppkey") % 8).alias("section_id"), F.col("l_discount").alias("value"), (F.col("l_returnflag") != "N").alias("inside"))
    return A.total_signal(li, "feature_id", "section_id", "value", "inside").select("feature_id", r("signal", 2))


@query("""WITH s AS (SELECT l_partkey AS mz, sum(l_quantity) AS signal FROM lineitem GROUP BY 1), k AS (SELECT mz % 40 AS annotation, mz, row_number() OVER (PARTITION BY mz % 40 ORDER BY signal DESC, mz) AS k FROM s) SELECT annotation, mz FROM k WHERE k = 1""")
def best_adduct(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mz")).agg(F.sum("l_quantity").alias("signal"))
    return A.best_by(s.withColumns({"annotation": F.col("mz") % 40, "at": F.col("mz")}), "annotation", "mz", "signal", "at")


@query(f"""WITH {EMB}, q AS (SELECT feature_id, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM emb GROUP BY 1)
SELECT pixel_id, emb.feature_id AS feature_id, round((greatest(lo, least(hi, value)) - lo) / nullif(hi - lo, 0), 6) AS scaled FROM emb JOIN q ON q.feature_id = emb.feature_id""")
def quantile_clip(spark, sf_dir):
    return A.clip_scale(emb_long(spark, sf_dir), "feature_id", "value").select("pixel_id", "feature_id", r("scaled"))


@query(f"""WITH {EMB}, q AS (SELECT feature_id, section_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM emb GROUP BY 1, 2)
SELECT feature_id, round(quantile_cont(lo, 0.5), 6) AS low, round(quantile_cont(hi, 0.5), 6) AS high FROM q GROUP BY 1""")
def section_quantile_medians(spark, sf_dir):
    return A.section_quantile_medians(emb_long(spark, sf_dir), "feature_id", "section_id", "value").select("feature_id", r("low"), r("high"))


@query(f"""WITH {EMB}, s AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM emb GROUP BY 1)
SELECT pixel_id, emb.feature_id AS feature_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM emb JOIN s ON s.feature_id = emb.feature_id""")
def standardise_columns(spark, sf_dir):
    return A.standardise_columns(emb_long(spark, sf_dir), "feature_id", "value").select("pixel_id", "feature_id", r("z"))


@query(f"""WITH {EMB}, s AS (SELECT pixel_id, avg(value) AS m, stddev_pop(value) AS s FROM emb GROUP BY 1)
SELECT emb.pixel_id AS pixel_id, feature_id, round((value - m) / (s + 1e-8), 6) AS z FROM emb JOIN s ON s.pixel_id = emb.pixel_id""")
def standardise_rows(spark, sf_dir):
    return A.standardise_rows(emb_long(spark, sf_dir), "pixel_id", "value").select("pixel_id", "feature_id", r("z"))


@query(f"WITH {CORR} SELECT src, dst, round(weight, 6) AS weight FROM w")
def feature_correlation(spark, sf_dir):
    return G.correlation_edges(emb_long(spark, sf_dir), "pixel_id", "feature_id", "value", -2.0).select("src", "dst", r("weight"))


@query(f"""WITH RECURSIVE {CORR}, e AS (SELECT src AS a, dst AS b FROM w WHERE weight > 0.1 UNION SELECT dst, src FROM w WHERE weight > 0.1), c(node, seen) AS (SELECT a, a FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT node, min(seen) AS component FROM c GROUP BY 1""")
def connected_components(spark, sf_dir):
    e = G.correlation_edges(emb_long(spark, sf_dir), "pixel_id", "feature_id", "value", 0.1)
    return G.connected_components(e, "src", "dst").select("node", "component")


@query(f"""WITH {CORR}, e AS (SELECT * FROM w WHERE weight > 0.02), t AS (SELECT sum(weight) AS m FROM e), i AS (SELECT src % 4 AS c, sum(weight) AS i FROM e WHERE src % 4 = dst % 4 GROUP BY 1),
d AS (SELECT c, sum(weight) AS d FROM (SELECT src % 4 AS c, weight FROM e UNION ALL SELECT dst % 4, weight FROM e) GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS communities, round(sum(coalesce(i, 0.0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS q FROM d LEFT JOIN i USING (c) CROSS JOIN t""")
def modularity(spark, sf_dir):
    e = G.correlation_edges(emb_long(spark, sf_dir), "pixel_id", "feature_id", "value", 0.02)
    labels = emb_long(spark, sf_dir).select(F.col("feature_id").alias("node")).distinct().withColumn("community", F.col("node") % 4)
    return G.modularity(e, labels).select(n("communities"), r("q"))


@query(f"""WITH {EMB}, a AS (SELECT zone AS supertype, feature_id AS feature, CASE WHEN abs(avg(value)) < 0.01 THEN 0.0 ELSE avg(value) END AS fc FROM emb GROUP BY 1, 2), s AS (SELECT feature, avg(fc) AS m, stddev_samp(fc) AS s FROM a GROUP BY 1 HAVING stddev_samp(fc) > 0),
z AS (SELECT supertype, a.feature AS feature, CASE WHEN fc = 0 THEN 0.0 ELSE abs((fc - m) / s) END AS z FROM a JOIN s ON s.feature = a.feature), e AS (SELECT feature AS u, feature + 1 AS v FROM s WHERE feature % 4 < 3 AND feature + 1 IN (SELECT feature FROM s))
SELECT x.supertype % 3 AS cluster, u, v, round(avg(x.z * y.z), 6) AS score FROM e JOIN z x ON x.feature = u JOIN z y ON y.feature = v AND y.supertype = x.supertype GROUP BY 1, 2, 3""")
def edge_modulation(spark, sf_dir):
    m = A.centroids(emb_long(spark, sf_dir), "zone").select(F.col("zone").alias("supertype"), F.col("feature_id").alias("feature"), F.when(F.abs("mean") < 0.01, 0.0).otherwise(F.col("mean")).alias("fc"))
    f = emb_long(spark, sf_dir).select(F.col("feature_id").alias("u")).distinct()
    edges = f.where("u % 4 < 3").withColumn("v", F.col("u") + 1)
    clusters = m.select("supertype").distinct().withColumn("cluster", F.col("supertype") % 3)
    return G.edge_modulation(m, edges, clusters).select("cluster", "u", "v", r("score"))


@query(f"""WITH {EMB}, m AS (SELECT zone AS supertype, feature_id, avg(value) AS loc FROM emb GROUP BY 1, 2) SELECT supertype, feature_id, round(1 / (1 + exp(-loc)), 6) AS baseline, round(0.1 * loc / (1 / (1 + exp(-loc))), 6) AS foldchange FROM m""")
def shift_foldchange(spark, sf_dir):
    m = A.centroids(emb_long(spark, sf_dir), "zone").select(F.col("zone").alias("supertype"), "feature_id", F.col("mean").alias("loc"), (0.1 * F.col("mean")).alias("shift"))
    return I.fold_changes(m, "loc", "shift").select("supertype", "feature_id", r("baseline"), r("foldchange"))


@query(f"""WITH {EMB}, m AS (SELECT zone AS supertype, feature_id, avg(value) AS s, 0.5 + avg(value) AS b FROM emb GROUP BY 1, 2) SELECT supertype, feature_id, round(CASE WHEN b > 0.5 AND abs(s) > 0.01 THEN log2((s + b) / b) ELSE 0.0 END, 6) AS log2fc FROM m""")
def comodulation_log2(spark, sf_dir):
    m = A.centroids(emb_long(spark, sf_dir), "zone").select(F.col("zone").alias("supertype"), "feature_id", F.col("mean").alias("s")).withColumn("b", 0.5 + F.col("s"))
    m = m.withColumns({"expressed": F.col("b") > 0.5, "shifted": F.abs("s") > 0.01})
    return I.comodulation(m, "s", "b", "expressed", "shifted").select("supertype", "feature_id", r("log2fc"))


@query(f"""WITH {EMB}, h(factor, feature_id, h) AS (SELECT f, g, CAST((f + 2 * g) % 5 AS DOUBLE) / 4 FROM range(0, 64) a(f), range(0, 8) b(g)), z AS (SELECT pixel_id, feature_id AS factor, value AS z FROM emb),
p AS (SELECT pixel_id, h.feature_id AS feature_id, sum(z * h) AS v FROM z JOIN h ON h.factor = z.factor GROUP BY 1, 2) SELECT pixel_id, feature_id, round(v - (SELECT min(v) FROM p) + 1e-7, 6) AS value FROM p""")
def reconstruction(spark, sf_dir):
    h = spark.createDataFrame([(f, g, ((f + 2 * g) % 5) / 4) for f in range(64) for g in range(8)], "factor long, feature_id long, h double")
    z = emb_long(spark, sf_dir).select("pixel_id", F.col("feature_id").alias("factor"), F.col("value").alias("z"))
    return L.reconstruct(z, h).select("pixel_id", "feature_id", r("value"))


@query(f"""WITH {EMB}, s AS (SELECT * FROM emb), o AS (SELECT section_id, feature_id, avg(value) AS o FROM s GROUP BY 1, 2), a AS (SELECT feature_id, avg(value) AS a FROM s GROUP BY 1)
SELECT pixel_id, s.feature_id AS feature_id, round(value - o + a, 6) AS value FROM s JOIN o ON o.section_id = s.section_id AND o.feature_id = s.feature_id JOIN a ON a.feature_id = s.feature_id""")
def batch_centring(spark, sf_dir):
    return L.centre_batches(emb_long(spark, sf_dir), "section_id", "pixel_id", "feature_id", "value").select("pixel_id", "feature_id", r("value"))


@query(f"WITH {EMB}, m AS (SELECT pixel_id FROM emb GROUP BY 1 HAVING avg(value) > 0.001) SELECT emb.pixel_id AS pixel_id, feature_id, round(value, 6) AS value FROM emb JOIN m ON m.pixel_id = emb.pixel_id")
def empty_pixel_filter(spark, sf_dir):
    return X.drop_empty_pixels(emb_long(spark, sf_dir), floor=0.001).select("pixel_id", "feature_id", r("value"))


@query(f"WITH {EMB} SELECT pixel_id, feature_id, round(CASE WHEN value > 0.1 THEN 0.0001 ELSE value END, 6) AS value FROM emb")
def winsor_floor(spark, sf_dir):
    return emb_long(spark, sf_dir).select("pixel_id", "feature_id", X.winsor_floor(F.col("value"), 0.1).alias("value")).select("pixel_id", "feature_id", r("value"))


@query(f"WITH {EMB} SELECT pixel_id, feature_id, round(exp(value), 6) AS value FROM emb")
def delog(spark, sf_dir):
    return X.delog(emb_long(spark, sf_dir)).select("pixel_id", "feature_id", r("value"))


@query(f"WITH {EMB}, k AS (SELECT feature_id FROM emb GROUP BY 1 HAVING var_samp(value) >= 0.0155) SELECT DISTINCT emb.feature_id AS feature_id FROM emb JOIN k ON k.feature_id = emb.feature_id")
def low_variance_drop(spark, sf_dir):
    return X.drop_low_variance(emb_long(spark, sf_dir), least=0.0155).select("feature_id").distinct()


@query(f"""WITH {EMB}, f AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS k FROM (SELECT DISTINCT feature_id FROM emb WHERE feature_id % 3 = 0)) SELECT feature_id, CAST(k AS BIGINT) AS new_feature_id FROM f""")
def feature_subset(spark, sf_dir):
    f = emb_long(spark, sf_dir).select("feature_id").distinct()
    return X.subset_features(f, f.where("feature_id % 3 = 0"), "feature_id", "feature_id").select("feature_id", n("new_feature_id"))


@query(f"""WITH {EMB}, b AS (SELECT pixel_id, section_id, feature_id, value, row_number() OVER (PARTITION BY pixel_id ORDER BY value DESC, feature_id) AS k FROM emb), w AS (SELECT * FROM b WHERE k = 1),
q AS (SELECT section_id, feature_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM w GROUP BY 1, 2)
SELECT pixel_id, w.section_id AS section_id, w.feature_id AS feature_id, round(coalesce((greatest(lo, least(hi, value)) - lo) / nullif(hi - lo, 0), 0.0), 6) AS scaled FROM w JOIN q ON q.section_id = w.section_id AND q.feature_id = w.feature_id""")
def argmax_channel(spark, sf_dir):
    return W.argmax_channel(emb_long(spark, sf_dir), "pixel_id", "feature_id", "value", "section_id").select("pixel_id", "section_id", "feature_id", r("scaled"))


@query(f"""WITH {EMB}, a AS (SELECT value AS a, row_number() OVER (ORDER BY value) AS rank FROM emb WHERE zone = 0), b AS (SELECT value AS b, row_number() OVER (ORDER BY value) AS rank FROM emb WHERE zone = 1)
SELECT CAST(a.rank AS BIGINT) AS rank, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b ON a.rank = b.rank""")
def qq_pairs(spark, sf_dir):
    from ..operators.joins import aligned_pairs
    e = emb_long(spark, sf_dir)
    return aligned_pairs(e.where("zone = 0"), e.where("zone = 1"), "value").select(n("rank"), r("a"), r("b"))


@query(f"""WITH {EMB} SELECT feature_id, CAST(count(*) FILTER (value > 0.1) AS BIGINT) AS nonzero, round(avg(CASE WHEN value > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM emb GROUP BY 1""")
def nonzero_fraction(spark, sf_dir):
    e = emb_long(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.1, F.col("value")).otherwise(0.0))
    return A.nonzero(e, "feature_id", "value").select("feature_id", n("nonzero"), r("fraction"))


@query(f"""WITH {EMB} SELECT feature_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM emb GROUP BY 1""")
def draw_summary(spark, sf_dir):
    return A.draw_summary(emb_long(spark, sf_dir), ["feature_id"], "value").select("feature_id", r("mean"), r("sd"), r("low"), r("high"))


@query(f"""WITH {EMB}, s AS (SELECT feature_id, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS u, avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END) AS d, avg(value) AS m, stddev_pop(value) AS s FROM emb GROUP BY 1), q AS (SELECT *, least(u, d) AS pep FROM s),
w AS (SELECT *, avg(pep) OVER (ORDER BY pep, feature_id ROWS UNBOUNDED PRECEDING) AS q FROM q)
SELECT feature_id, round(u, 6) AS p_up, round(d, 6) AS p_down, round(pep, 6) AS pep, round(q, 6) AS q, q < 0.05 AS selected, round(m - 1.96 * s, 6) AS low, round(m + 1.96 * s, 6) AS high FROM w""")
def posterior_summary(spark, sf_dir):
    return I.posterior_summary(emb_long(spark, sf_dir), ["feature_id"], "value").select("feature_id", r("p_up"), r("p_down"), r("pep"), r("q"), "selected", r("low"), r("high"))


@query("""WITH c AS (SELECT l_linenumber AS section, l_returnflag AS supertype, count(l_quantity) AS n, avg(l_quantity) AS m, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT CAST(section AS BIGINT) AS section, supertype, CAST(n AS BIGINT) AS n, round(m, 6) AS mean, round(s, 4) AS sum, round(q, 4) AS sum_squares FROM c""")
def anova_sufficient_stats(spark, sf_dir):
    c = A.cell_means(table(spark, sf_dir, "lineitem").withColumn("section", F.col("l_linenumber").cast("long")).withColumn("supertype", F.col("l_returnflag")), "section", "supertype", "l_quantity")
    return c.select("section", "supertype", n("n"), r("mean"), r("sum", 4), r("sum_squares", 4))


ICC = """b AS (SELECT {k} l_suppkey % 20 AS subject, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY ALL), g AS (SELECT {k} sum(n * m) / sum(n) AS grand FROM b {group}),
a AS (SELECT {bk} count(*) AS subjects, sum(n) AS rows, avg(n) AS size, sum(n * (m - grand) * (m - grand)) AS ssb, sum(n * v) AS ssw FROM b {join} {group2}), m AS (SELECT *, ssb / nullif(subjects - 1, 0) AS msb, ssw / nullif(rows - subjects, 0) AS msw FROM a)
SELECT {k} CAST(subjects AS BIGINT) AS subjects, CAST(rows AS BIGINT) AS rows, round(msb, 2) AS msb, round(msw, 2) AS msw, round(CASE WHEN subjects >= 2 THEN (msb - msw) / size / nullif((msb - msw) / size + msw, 0) END, 8) AS icc FROM m"""


@query("WITH " + ICC.format(k="", bk="", group="", join="CROSS JOIN g", group2=""))
def icc(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("subject", F.col("l_suppkey") % 20)
    return A.icc(li, "subject", "l_extendedprice").select(n("subjects"), n("rows"), r("msb", 2), r("msw", 2), r("icc", 8))


@query("WITH " + ICC.format(k="l_returnflag,", bk="b.l_returnflag AS l_returnflag,", group="GROUP BY l_returnflag", join="JOIN g ON g.l_returnflag = b.l_returnflag", group2="GROUP BY b.l_returnflag"))
def icc_by_stratum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("subject", F.col("l_suppkey") % 20)
    return A.icc(li, "subject", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", n("subjects"), n("rows"), r("msb", 2), r("msw", 2), r("icc", 8))


RANKS = """x AS (SELECT l_linenumber AS f, l_returnflag AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), k AS (SELECT f, g, v, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS r FROM x),
s AS (SELECT f, count(*) FILTER (g = 'A') AS na, count(*) FILTER (g = 'R') AS nb, sum(r) FILTER (g = 'A') AS ra FROM k GROUP BY 1)"""


@query(f"WITH {RANKS} SELECT CAST(f AS BIGINT) AS feature_id, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(ra, 1) AS rank_sum, round(ra - na * (na + 1) / 2.0, 1) AS u FROM s")
def midranks_u(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("feature_id", F.col("l_linenumber").cast("long"))
    return W.rank_sums(li, "feature_id", "l_returnflag", "l_quantity", "A", "R").select("feature_id", n("n_a"), n("n_b"), r("rank_sum", 1), r("u", 1))


@query(f"""WITH {RANKS}, m AS (SELECT l_linenumber AS f, avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'R') AS mb FROM lineitem GROUP BY 1)
SELECT CAST(s.f AS BIGINT) AS feature_id, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(log2((mb + 1e-11) / (ma + 1e-11)), 6) AS log2fc, round(ra - na * (na + 1) / 2.0, 1) AS u FROM s JOIN m ON m.f = s.f""")
def differential_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("feature_id", F.col("l_linenumber").cast("long"))
    return I.differential(li, "feature_id", "l_returnflag", "l_quantity", "A", "R").select("feature_id", r("mean_a"), r("mean_b"), r("log2fc"), r("u", 1))


# erfc(w) = 1 - exp(-w^2) * sum of w^(2i+1) / gamma(i + 3/2); all terms are positive, and beyond 10 nothing is left
VERDICTS = """t AS (SELECT f, sum(c * c * c - c) AS ties FROM (SELECT f, v, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT f, avg(v) FILTER (g = 'A') AS ma, avg(v) FILTER (g = 'R') AS mb FROM x GROUP BY 1),
z AS (SELECT s.f, ma, mb, greatest(0.0, abs(ra - na * (na + 1) / 2.0 - na * nb / 2.0) - 0.5) / sqrt(na * nb / 12.0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1.0)))) / sqrt(2.0) AS w FROM s JOIN t ON t.f = s.f JOIN m ON m.f = s.f),
e AS (SELECT f, CASE WHEN w = 0 THEN 1.0 WHEN w > 10 THEN 0.0 ELSE 1 - (SELECT sum(exp((2 * i + 1) * ln(w) - w * w - lgamma(i + 1.5))) FROM range(0, 300) AS g(i)) END AS p, log2((mb + 1e-11) / (ma + 1e-11)) AS change FROM z),
o AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, f) AS q FROM e), b AS (SELECT *, least(1.0, min(q) OVER (ORDER BY p DESC, f DESC ROWS UNBOUNDED PRECEDING)) AS adjusted FROM o)"""


@query(f"""WITH {RANKS}, {VERDICTS}
SELECT CAST(f AS BIGINT) AS feature_id, round(p, 9) AS p, round(adjusted, 9) AS adjusted, abs(change) > 0.2 AND adjusted < 0.05 AS passes FROM b""")
def differential_p_values(spark, sf_dir):
    """p, adjusted p and verdict of the same comparison."""
    li = table(spark, sf_dir, "lineitem").withColumn("feature_id", F.col("l_linenumber").cast("long"))
    return I.differential(li, "feature_id", "l_returnflag", "l_quantity", "A", "R").select("feature_id", r("p", 9), r("adjusted", 9), "passes")


@query(f"""WITH {RANKS.replace("l_returnflag AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')", "CASE WHEN l_discount > 0.05 THEN 'R' ELSE 'A' END AS g, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * l_quantity ELSE l_quantity END AS v FROM lineitem")}, {VERDICTS}
SELECT count(*) FILTER (abs(change) > 0.2 AND adjusted < 0.05) AS altered, count(*) AS features FROM b""")
def altered_features(spark, sf_dir):
    """How many line numbers differ between high and low discounts: those whose value is the discounted quantity."""
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * F.col("l_quantity")).otherwise(F.col("l_quantity"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("feature"), F.when(F.col("l_discount") > 0.05, "R").otherwise("A").alias("side"), value.alias("value"))
    return I.altered_count(li, "feature", "side", "value", "A", "R")


PS = "p AS (SELECT p_partkey AS id, CAST((p_partkey * 7919) % 1009 AS DOUBLE) / 1009 AS p FROM part)"


def _ps(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") * 7919) % 1009).cast("double") / 1009).alias("p"))


@query(f"WITH {PS} SELECT id, round(avg(p) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 6) AS q FROM p")
def qvalue_running_mean(spark, sf_dir):
    return W.running_q(_ps(spark, sf_dir), "p", "id").select("id", r("q"))


@query(f"""WITH {PS}, k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p) SELECT id, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM k""")
def bh_adjust(spark, sf_dir):
    return W.benjamini_hochberg(_ps(spark, sf_dir), "p", "id").select("id", r("adjusted"))


@query("""WITH m AS (SELECT l_linenumber AS f, l_suppkey % 8 AS s, avg(l_discount) * 10 AS v FROM lineitem GROUP BY 1, 2), k AS (SELECT f, s, v, row_number() OVER (PARTITION BY f ORDER BY v DESC, s) AS k FROM m WHERE v >= 0.4)
SELECT CAST(f AS BIGINT) AS feature_id, s AS section_id, round(v, 6) AS value FROM k WHERE k <= 3""")
def top_n_above_threshold(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("feature_id"), (F.col("l_suppkey") % 8).alias("section_id")).agg((F.avg("l_discount") * 10).alias("value"))
    return W.top_above(m, "feature_id", "value", "section_id").select("feature_id", "section_id", r("value"))


@query("""WITH m AS (SELECT l_linenumber AS f, l_suppkey % 8 AS s, avg(l_discount) * 10 AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT f FROM m WHERE v > 0.45 GROUP BY 1 HAVING count(*) > 3),
k AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY v DESC, s) AS k FROM m WHERE v >= 0.45 AND f IN (SELECT f FROM w)), t AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY s) - 1 AS i FROM k WHERE k <= 3)
SELECT CAST(f AS BIGINT) AS feature_id, s AS section_id, CASE WHEN i = 1 THEN 'val' ELSE 'train' END AS role FROM t""")
def restoration_usage(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("feature_id"), (F.col("l_suppkey") % 8).alias("section_id")).agg((F.avg("l_discount") * 10).alias("moran_i"))
    return R.usage(m, threshold=0.45)


@query("""WITH c AS (SELECT l_returnflag || l_linestatus AS g, l_suppkey % 12 AS s, count(*) AS n FROM lineitem WHERE l_suppkey % 12 <> 5 GROUP BY 1, 2), k AS (SELECT g, n >= 10 AS o, lead(n >= 10) OVER (PARTITION BY g ORDER BY s) AS x FROM c)
SELECT g AS zone, CAST(count(*) FILTER (o) AS BIGINT) AS sections, coalesce(bool_or(o AND x), false) AS consecutive, count(*) FILTER (o) > 3 AND coalesce(bool_or(o AND x), false) AS continuous FROM k GROUP BY 1""")
def section_continuity(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").where("l_suppkey % 12 <> 5").groupBy(F.concat("l_returnflag", "l_linestatus").alias("zone"), (F.col("l_suppkey") % 12).alias("section_id")).agg(F.count("*").alias("n"))
    return W.consecutive_sections(c, "zone", "section_id", "n").select("zone", n("sections"), "consecutive", "continuous")


@query(r"""WITH c AS (SELECT l_returnflag AS g, l_suppkey % 12 AS s, count(*) * (1 + l_suppkey % 12 % 4) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT d, exp(-d * d / 6.48) AS w FROM range(-7, 8) t(d)),
b AS (SELECT g, unnest(range(min(s), max(s) + 1)) AS s FROM c GROUP BY 1), v AS (SELECT g, s + d AS s, sum(n * w / (SELECT sum(w) FROM k)) AS v FROM c, k GROUP BY 1, 2)
SELECT b.g AS zone, b.s AS section_id, round(coalesce(v, 0.0), 4) AS smooth FROM b LEFT JOIN v ON v.g = b.g AND v.s = b.s""")
def section_smoothing(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("zone"), (F.col("l_suppkey") % 12).alias("section_id")).agg(F.count("*").alias("n")).withColumn("n", F.col("n") * (1 + F.col("section_id") % 4))
    return W.smoothed(c, "zone", "section_id", "n").select("zone", "section_id", r("smooth", 4))


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 12 AS s FROM lineitem), k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT s AS section_id, CASE WHEN i % 5 = 2 AND i < n - 1 THEN 'val' WHEN i % 5 = 1 THEN 'test' ELSE 'train' END AS part FROM k""")
def section_split(spark, sf_dir):
    return W.section_split(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("section_id")), "section_id")


@query("""WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) AS k FROM labels), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM k, m WHERE k <= n""")
def balanced_undersample(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    return W.balanced_undersample(d, "quality", [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")]).select("doc_id", n("quality"))


# ---- iterative operators: no SQL; tests hold their invariants -------------------------------------------------------------

def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("pixel_id"), (F.col("vec_id") % 5).alias("section_id"), F.col("label").cast("long").alias("zone"), v.alias("features"))


@query()
def nmf_loadings(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return L.apply_nmf(p, "features", L.fit_nmf(p, "features")).select("pixel_id", "loadings")


@query()
def kmeans_zones(spark, sf_dir):
    return L.kmeans(_pixels(spark, sf_dir), "features", 10).select("pixel_id", "cluster")


@query()
def harmonised(spark, sf_dir):
    return L.harmonise(_pixels(spark, sf_dir), "features", "section_id").select("pixel_id", "harmonised")


@query()
def layout(spark, sf_dir):
    return L.layout_2d(_pixels(spark, sf_dir), "features").select("pixel_id", r("layout_x"), r("layout_y"))


@query()
def pixel_layout(spark, sf_dir):
    return Y.pixel_layout(_pixels(spark, sf_dir), "features", "pixel_id").select("pixel_id", r("layout_x", 3), r("layout_y", 3))


@query()
def zone_layout(spark, sf_dir):
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone")
    at = Y.tsne(m.to_numpy())
    return spark.createDataFrame([(int(z), float(x), float(y)) for z, (x, y) in zip(m.index, at)], "zone long, layout_x double, layout_y double")


@query()
def molecule_layout(spark, sf_dir):
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone").T
    at = Y.umap(m.to_numpy())
    return spark.createDataFrame([(int(f), float(x), float(y)) for f, (x, y) in zip(m.index, at)], "feature_id long, layout_x double, layout_y double")


@query()
def shared_factors(spark, sf_dir):
    """Factors of two views of the line items: quantity and discount, price and tax."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.log1p("l_quantity"), 10 * F.col("l_discount"), F.log1p("l_extendedprice"), 10 * F.col("l_tax")).alias("v"))
    mean, loadings, noise = Y.view_factors(li, "v", [0, 0, 1, 1], factors=3)
    scores = Y.factor_scores(li, "v", mean, loadings, noise)
    return scores.select("l_orderkey", "l_linenumber", F.posexplode("factors").alias("factor", "score")).select("l_orderkey", "l_linenumber", "factor", r("score", 4))


@query()
def communities(spark, sf_dir):
    corr = np.abs(L.correlation(_pixels(spark, sf_dir), "features"))
    np.fill_diagonal(corr, 0)
    labels = G.resolution_sweep(corr)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "feature_id long, community long")


@query()
def case_control_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_linenumber").cast("long").alias("feature"), (F.col("l_suppkey") % 4 + F.when(F.col("l_returnflag") == "A", 0).otherwise(4)).alias("section"), (F.col("l_suppkey") % 2).alias("sample"), F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("supertype"), (F.col("l_discount") * 5).alias("value"))
    fit = I.fit_case_control(li, "feature", "section", "sample", "condition", "supertype", "value", "R")
    return fit.select("feature", "supertype", r("baseline", 4), r("shift", 4))


@query()
def case_control_calls(spark, sf_dir):
    m = A.centroids(emb_long(spark, sf_dir), "zone").select(F.col("zone").alias("supertype"), F.col("feature_id").alias("feature"), F.col("mean").alias("loc"), F.lit(0.1).alias("loc_sd"), (5 * F.col("mean")).alias("shift"), F.lit(0.1).alias("shift_sd"))
    return I.calls(m, ["feature", "supertype"])


@query()
def bootstrap_ci(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("hit"), (F.col("l_discount") > 0.02).alias("within"))
    return I.bootstrap_fraction(li, ["l_returnflag"], "hit", "within")


@query()
def restore_feature(spark, sf_dir):
    """All features from the others' first eight components: r and error on a section that did not train."""
    p = _pixels(spark, sf_dir).withColumn("embedding", F.slice("features", 2, 8))
    long = emb_long(spark, sf_dir).select("pixel_id", "section_id", "feature_id", "value")
    sections = F.array(*(F.struct(F.lit(s).cast("long").alias("section_id"), F.lit(role).alias("role")) for s, role in ((0, "train"), (1, "val"), (2, "train"))))
    roles = long.select("feature_id").distinct().select("feature_id", F.explode(sections).alias("x")).select("feature_id", "x.section_id", "x.role")
    return R.restore(p, long, roles)[1]


@query(f"""WITH {EMB}, s AS (SELECT feature_id, avg(exp(value)) AS mean, stddev_pop(exp(value)) / nullif(avg(exp(value)), 0) AS cv FROM emb GROUP BY 1), l AS (SELECT *, log2(mean) AS x, log2(cv) AS y FROM s WHERE mean > 0 AND cv > 0),
f AS (SELECT covar_pop(x, y) / nullif(var_pop(x), 0) AS b, avg(x) AS mx, avg(y) AS my FROM l), e AS (SELECT feature_id, mean, cv, y - (my + coalesce(b, 0.0) * (x - mx)) AS excess FROM l, f)
SELECT feature_id, round(mean, 6) AS mean, round(cv, 6) AS cv, round(excess, 6) AS excess FROM e ORDER BY e.excess DESC, feature_id LIMIT 20""")
def noise_ranking(spark, sf_dir):
    e = emb_long(spark, sf_dir).withColumn("value", F.exp("value"))
    return L.noise_ranking(e, "feature_id", "value", 20).select("feature_id", r("mean"), r("cv"), r("excess"))


@query()
def zone_tree(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("embedding", F.slice("features", 1, 8))
    return C.with_levels(C.learn_tree(p)[1]).select("pixel_id", "zone")


@query()
def noise_selection(spark, sf_dir):
    e = emb_long(spark, sf_dir).withColumn("value", F.exp("value"))
    return L.noise_selection(e, "feature_id", "value", 20).select("feature_id", r("mean"), r("cv"), r("excess"))


@query()
def noise_selection_support(spark, sf_dir):
    """The same with a support vector curve as the model of noise."""
    e = emb_long(spark, sf_dir).withColumn("value", F.exp("value"))
    return L.noise_selection(e, "feature_id", "value", 20, "support").select("feature_id", r("mean"), r("cv"), r("excess"))


@query()
def apply_tree(spark, sf_dir):
    """All pixels led through the learned tree, with the zone that learning gave them."""
    p = _pixels(spark, sf_dir).withColumn("embedding", F.slice("features", 1, 8))
    root, learned = C.learn_tree(p)
    applied = C.with_levels(C.apply_tree(root, p)).select("pixel_id", "zone")
    return applied.join(C.with_levels(learned).select("pixel_id", F.col("zone").alias("learned_zone")), "pixel_id")


@query()
def pixel_communities(spark, sf_dir):
    """Communities of all pixels on the graph of their 15 nearest neighbours."""
    found = M.modularity_communities(G.knn_edges(_pixels(spark, sf_dir), "features", 15))
    return found.select(F.col("node").alias("pixel_id"), "community")


def _cases(spark, sf_dir):
    """Price, saving and tax of all line items between 0 and 1; high discounts are cases, each condition has four sections of
    two samples: savings go with discounts, the others do not."""
    case = (F.col("l_discount") > 0.05).cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumn("section", F.col("l_suppkey") % 4 + 4 * case)
    price = F.least(F.lit(1.0), F.col("l_extendedprice").cast("double") / 100_000)
    values = {"price": price, "saving": 10 * F.col("l_discount").cast("double") * price, "tax": 10 * F.col("l_tax").cast("double")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()))).alias("x")
    return rows.select("section", F.floor(F.col("section") / 2).alias("sample"), case.alias("condition"), F.col("l_linestatus").alias("supertype"), each).select("section", "sample", "condition", "supertype", "x.feature", "x.value")


@query()
def case_control_analysis(spark, sf_dir):
    out = I.case_control_analysis(_cases(spark, sf_dir), None, "feature", "section", "sample", "condition", "supertype", "value", 1)
    return out.select("feature", "supertype", r("baseline", 4), r("shift", 4), r("shift_sd", 5), r("shift_sd_joint", 5), "p_up", "p_down", "expressed", "shifted", r("log2fc", 4))


@query()
def case_control_samples(spark, sf_dir):
    """Means and spreads of the samples of the same comparison."""
    out = I.sample_effects(_cases(spark, sf_dir), "feature", "section", "sample", "condition", "supertype", "value", 1)
    return out.select("feature", "is_case", "sample", r("mean", 4), r("spread", 4))


@query(f"""WITH {EMB}, h AS (SELECT feature_id, value AS y, value * 0.9 + 0.01 AS p FROM emb) SELECT feature_id, round(covar_pop(y, greatest(p, 0)) / nullif(stddev_pop(y) * stddev_pop(greatest(p, 0)), 0), 6) AS r, round(sqrt(avg((y - greatest(p, 0)) * (y - greatest(p, 0)))), 6) AS rmse FROM h GROUP BY 1""")
def heldout_quality(spark, sf_dir):
    e = emb_long(spark, sf_dir).withColumn("p", F.col("value") * 0.9 + 0.01)
    return I.heldout(e, ["feature_id"], "value", "p").select("feature_id", r("r"), r("rmse"))


@query("""WITH e AS (SELECT vec_id AS section_id, unnest(range(0, CAST(len(embedding) AS BIGINT))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT section_id, CAST(i // 8 + 1 AS BIGINT) AS x, CAST(i % 8 + 1 AS BIGINT) AS y, round(v, 6) AS value FROM e WHERE v >= 0""")
def flatten_images(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    row = lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda v: F.when(v >= 0, v.cast("double")))
    images = e.select(F.col("vec_id").alias("section_id"), F.array(*(row(i) for i in range(8))).alias("image"))
    return X.flatten_images(images).select("section_id", n("x"), n("y"), r("value"))


@query(f"""WITH {EMB}, s AS ({STATS}), v AS (SELECT feature_id, avg(v) - var_pop(v) / 2 AS score, avg(abs(m)) AS moran, count(*) FILTER (m < -0.01) AS missing FROM s GROUP BY 1) SELECT feature_id FROM v WHERE moran > 0.008 AND missing < 3 AND score > 0""")
def selected_features(spark, sf_dir):
    e = emb_long(spark, sf_dir)
    means = e.groupBy("feature_id", "section_id").agg(F.avg("value").alias("m"))
    moran = means.select("feature_id", "section_id", F.abs("m").alias("moran_i"))
    return R.select_features(moran, A.variance_of_variances(e), A.section_dropout(e, "feature_id", "section_id", "value", -0.01, 3), threshold=0.008)


@query("""WITH native AS (SELECT p_partkey AS pixel_id, p_brand AS name, p_retailprice AS value FROM part WHERE p_brand < 'Brand#3'), restored AS (SELECT p_partkey AS pixel_id, p_type AS mz_key, p_retailprice / 2 AS value FROM part),
notes AS (SELECT DISTINCT p_type AS mz_key, CASE WHEN p_type LIKE '%O%' THEN 'N ' || p_type ELSE '_db' END AS annotation, CAST(length(p_type) AS DOUBLE) AS score FROM part)
SELECT pixel_id, name, round(value, 4) AS value FROM native UNION ALL SELECT pixel_id, annotation, round(value, 4) FROM restored JOIN notes ON restored.mz_key = notes.mz_key WHERE annotation <> '_db' AND score >= 6 AND annotation NOT IN (SELECT name FROM native)""")
def final_matrix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    native = p.where("p_brand < 'Brand#3'").select(F.col("p_partkey").alias("pixel_id"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("value"))
    restored = p.select(F.col("p_partkey").alias("pixel_id"), F.col("p_type").alias("mz_key"), (F.col("p_retailprice") / 2).alias("value"))
    notes = p.select(F.col("p_type").alias("mz_key")).distinct().select("mz_key", F.when(F.col("mz_key").contains("O"), F.concat(F.lit("N "), "mz_key")).otherwise("_db").alias("annotation"), F.length("mz_key").cast("double").alias("score"))
    return R.final_matrix(native, restored, notes, 6.0).select("pixel_id", "name", r("value", 4))


@query()
def spatial_modules(spark, sf_dir):
    """Modules of sources by their enrichment in languages."""
    t = A.enrichment(A.crosstab(table(spark, sf_dir, "documents"), "source", "lang"), "source", "lang")
    return G.spatial_modules(t, "source", "lang")


@query()
def biclusters(spark, sf_dir):
    """Two-way clusters of zones and features, in their order."""
    m = L.centroid_matrix(emb_long(spark, sf_dir), "zone")
    rows, columns, row_groups, column_groups = B.two_way_clusters(m.to_numpy().T)
    out = [("feature", int(m.columns[i]), k, int(g)) for k, (i, g) in enumerate(zip(rows, row_groups[:, -1]))]
    out += [("zone", int(m.index[i]), k, int(g)) for k, (i, g) in enumerate(zip(columns, column_groups[:, -1]))]
    return spark.createDataFrame(out, "axis string, id long, place long, cluster long")
