"""Filters, lookups, set operations and reshaping over plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as X
from ..operators import joins as J
from ..operators import windows as W
from .registry import n, query, r, table


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> 'F'")
def filter_neq(spark, sf_dir):
    return X.filter_by_spec(table(spark, sf_dir, "orders"), "o_orderstatus", "!=F").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def filter_eq(spark, sf_dir):
    return X.filter_by_spec(table(spark, sf_dir, "orders"), "o_orderstatus", "==O").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000")
def filter_expr(spark, sf_dir):
    return X.filter_by_spec(table(spark, sf_dir, "customer"), "c_acctbal", "> 1000").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%ING' OR c_mktsegment LIKE '%LE'")
def suffix_filter(spark, sf_dir):
    return X.ends_with_any(table(spark, sf_dir, "customer"), "c_mktsegment", ["ING", "LE"]).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_type FROM part WHERE NOT contains(p_type, 'AN')")
def substring_exclusion(spark, sf_dir):
    return X.without_substring(table(spark, sf_dir, "part"), "p_type", "AN").select("p_partkey", "p_type")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 10 = 0")
def systematic_sample(spark, sf_dir):
    return X.every_kth(table(spark, sf_dir, "orders").select("o_orderkey"), 10, ["o_orderkey"])


@query("SELECT p_type AS name FROM (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 4)")
def first_features(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().orderBy("name").limit(4)


@query("SELECT d.doc_id AS doc_id, lang, source, CAST(quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def metadata_lookup_semi(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("at", F.col("quality"))
    out = J.attach_metadata(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), labels, ["doc_id"], ["at"])
    return out.select("doc_id", "lang", "source", n("quality"))


@query("SELECT d.doc_id AS doc_id, CAST(quality AS DOUBLE) AS m0, CAST(toxic AS DOUBLE) AS m1 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def modality_left(spark, sf_dir):
    out = J.attach_modality(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])
    return out.select("doc_id", F.get("modality", F.lit(0)).alias("m0"), F.get("modality", F.lit(1)).alias("m1"))


@query("SELECT d.doc_id AS doc_id, CAST(quality AS DOUBLE) + CAST(toxic AS DOUBLE) AS total FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def program_inner(spark, sf_dir):
    out = J.attach_programs(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])
    return out.select("doc_id", (F.get("programs", F.lit(0)) + F.get("programs", F.lit(1))).alias("total"))


@query("SELECT d.doc_id AS doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def modality_align(spark, sf_dir):
    return J.aligned_modality(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", n("quality"), n("toxic"))


@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def section_metadata(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.attach_section_metadata(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


@query("SELECT d.doc_id AS doc_id, f.lang AS first_lang FROM documents d LEFT JOIN (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) f ON f.source = d.source AND k = 1")
def label_transfer_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = d.select("source", F.col("lang").alias("first_lang"), F.col("doc_id").alias("at"))
    return J.transfer_labels(d.select("doc_id", "source"), first, "source", ["at"]).select("doc_id", "first_lang")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.members(table(spark, sf_dir, "orders"), c, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def complement_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.complement(table(spark, sf_dir, "customer"), o, ["c_custkey"]).select("c_custkey")


@query("SELECT d.doc_id AS doc_id, CAST(coalesce(quality, 0) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def score_lookup(spark, sf_dir):
    return J.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "quality", 0).select("doc_id", n("quality"))


@query("""WITH c AS (SELECT r_name, n_name, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT r_name, n_name, s AS c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY r_name, n_name ORDER BY n DESC, s) AS k FROM c) WHERE k = 1""")
def modal_by_path(spark, sf_dir):
    return A.modal(_geo(spark, sf_dir), ["r_name", "n_name"], "c_mktsegment")


def _geo(spark, sf_dir):
    c, na, re = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(na), c.c_nationkey == na.n_nationkey).join(F.broadcast(re), na.n_regionkey == re.r_regionkey)  # 25 and 5 rows


@query("SELECT n_name, c_name FROM (SELECT n_name, c_name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k = 1")
def first_by_group(spark, sf_dir):
    return A.first_value(_geo(spark, sf_dir), ["n_name"], "c_name", ["c_custkey"])


@query("SELECT r_name, n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def treemap_rollup(spark, sf_dir):
    return A.treemap(_geo(spark, sf_dir), ["r_name", "n_name", "c_mktsegment"])


@query("""WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(least(11, floor((p_retailprice - lo) * 12 / nullif(hi - lo, 0))) AS BIGINT) AS bin, p_type, CAST(count(*) AS BIGINT) AS n FROM part, e GROUP BY 1, 2""")
def binned_histogram(spark, sf_dir):
    return A.histogram_2d(table(spark, sf_dir, "part"), "p_retailprice", "p_type", 12)


@query("SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 100 * 10) + 1 END AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_1d(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10).select(n("bucket"), n("n"))


@query("SELECT l_returnflag, round(min(l_quantity), 2) AS min_l_quantity, round(max(l_quantity), 2) AS max_l_quantity, round(min(l_tax), 4) AS min_l_tax, round(max(l_tax), 4) AS max_l_tax FROM lineitem GROUP BY 1")
def group_extents(spark, sf_dir):
    return A.extents(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax").select("l_returnflag", r("min_l_quantity", 2), r("max_l_quantity", 2), r("min_l_tax", 4), r("max_l_tax", 4))


@query("SELECT DISTINCT n_nationkey, n_regionkey FROM nation")
def unique_mapping(spark, sf_dir):
    return A.unique_mapping(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("""WITH k AS (SELECT p_partkey, p_brand AS name, count(*) OVER (PARTITION BY p_brand) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN c > 1 THEN name || '_' || k ELSE name END AS unique_name FROM k""")
def dedupe_names_all(spark, sf_dir):
    return W.number_repeats(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("""WITH k AS (SELECT p_partkey, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, CASE WHEN k > 0 THEN name || '_' || k ELSE name END AS unique_name FROM k""")
def dedupe_names_keep_first(spark, sf_dir):
    return W.number_later_repeats(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT doc_id, CAST(k - 1 AS BIGINT) AS code FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)) USING (source)")
def label_codes(spark, sf_dir):
    return W.dense_codes(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", n("code"))


@query("""WITH s AS (SELECT l_suppkey AS id, sum(l_quantity) AS v FROM lineitem GROUP BY 1), k AS (SELECT id, v, row_number() OVER (ORDER BY v, id) AS u, row_number() OVER (ORDER BY v DESC, id) AS d FROM s) SELECT id, CASE WHEN u <= 5 THEN 'low' ELSE 'high' END AS "end" FROM k WHERE u <= 5 OR d <= 5""")
def rank_extremes(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    return W.rank_extremes(s, "v", "id").where("end <> 'middle'").select("id", "end")


@query("SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def key_intersection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def key_union(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def row_concat(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))


@query("SELECT lang, CAST(count(*) FILTER (source = 'src0') AS BIGINT) AS src0, CAST(count(*) FILTER (source = 'src1') AS BIGINT) AS src1 FROM documents WHERE source IN ('src0', 'src1') GROUP BY 1")
def pivot_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("source IN ('src0', 'src1')").groupBy("lang").pivot("source", ["src0", "src1"]).count()
    return t.select("lang", F.coalesce("src0", F.lit(0)).alias("src0"), F.coalesce("src1", F.lit(0)).alias("src1"))


@query("SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def melt_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "name", "value")


@query("""WITH s AS (SELECT l_returnflag AS f, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS items FROM lineitem GROUP BY 1)
SELECT 'items' AS measure, max(items) FILTER (f = 'A') AS "A", max(items) FILTER (f = 'N') AS "N", max(items) FILTER (f = 'R') AS "R" FROM s
UNION ALL SELECT 'quantity', max(quantity) FILTER (f = 'A'), max(quantity) FILTER (f = 'N'), max(quantity) FILTER (f = 'R') FROM s""")
def transposed(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("items"))
    return J.transpose(s, "l_returnflag", ["quantity", "items"], "measure")


@query("SELECT source, lang FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT DISTINCT lang FROM documents)")
def category_grid(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("source").distinct().crossJoin(F.broadcast(d.select("lang").distinct()))  # categories only


@query("SELECT vec_id, CAST(2 * len(embedding) AS BIGINT) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_stack(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("stacked", F.concat("embedding", "embedding"))
    return e.select("vec_id", F.size("stacked").cast("long").alias("size"), F.round(F.get("stacked", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT user_id, event_type, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS BIGINT) AS frame FROM (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2)")
def first_appearance(spark, sf_dir):
    from pyspark.sql.window import Window
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return f.select("user_id", "event_type", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first_ts", "event_type")).cast("long").alias("frame"))


@query("SELECT o_orderkey, trim(o_orderpriority) AS path, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) IS NULL AS bad, CAST(TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS BIGINT) AS x FROM orders")
def normalised_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("path"), F.get(F.split("o_orderpriority", "-"), F.lit(0)).alias("x"))
    return X.normalise_keys(o, ["path"], ["x"]).select("o_orderkey", "path", F.col("x").isNull().alias("bad"), n("x"))
