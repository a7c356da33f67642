"""Annotation of peaks, molecule names and the reaction network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import joins as J
from .registry import n, query, r, table

CLASSES = ("PC", "PE", "LPC", "LPE", "PC O-", "PS", "PA", "DG", "SM", "Cer", "HexCer", "PG")
ENZYMES = ((("PC", "PA"), ["PLD"]), (("SM", "Cer"), ["SMase"]), (("Cer", "SM"), ["SGMS1", "SGMS2"]), (("PC", "LPC"), ["PLA2"]))
SEPARATED = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
MOL = f"mol AS (SELECT DISTINCT c || CASE WHEN c LIKE '% O-' THEN '' ELSE ' ' END || (30 + p_size % 6) || ':' || (p_size % 3) AS name FROM (SELECT {SEPARATED} AS c, p_size FROM part))"
PROPS = r"""props AS (SELECT name, nullif(regexp_extract(name, '^([A-Za-z0-9]+ O-|[A-Za-z0-9]+)', 1), '') AS class, TRY_CAST(nullif(regexp_extract(name, '(\d+):', 1), '') AS INTEGER) AS carbons, TRY_CAST(nullif(regexp_extract(name, ':(\d+)', 1), '') AS INTEGER) AS unsaturation FROM mol)"""
PEAKS = "peaks AS (SELECT DISTINCT c_acctbal AS mz FROM customer)"
REFS = "refs AS (SELECT p_retailprice AS mass, min(p_partkey) AS ref_id FROM part GROUP BY 1)"


def molecules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    name = F.concat(c, F.when(c.endswith(" O-"), F.lit("")).otherwise(F.lit(" ")), (30 + F.col("p_size") % 6).cast("string"), F.lit(":"), (F.col("p_size") % 3).cast("string"))
    return p.select(name.alias("name")).distinct()


def peaks(spark, sf_dir):
    """Distinct masses.  Grouping makes 0 of -0; where only -0 is there, it stays (DISTINCT keeps it)."""
    mz = F.col("c_acctbal")
    each = table(spark, sf_dir, "customer").groupBy(mz.alias("mz")).agg(F.bool_and(mz.cast("string") == "-0.0").alias("_negative"))
    return each.select(F.when(F.col("_negative"), F.lit(-0.0)).otherwise(F.col("mz")).alias("mz"))


def references(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_retailprice").alias("mass")).agg(F.min("p_partkey").alias("ref_id"))


@query(f"""WITH {PEAKS}, {REFS}, c AS (SELECT mz, mass, ref_id, row_number() OVER (PARTITION BY mz ORDER BY abs(mz - mass), ref_id) AS k FROM peaks JOIN refs ON abs(mz - mass) <= 0.04)
SELECT peaks.mz AS mz, ref_id, round(1e6 * abs(peaks.mz - mass) / mass, 4) AS ppm_error FROM peaks LEFT JOIN c ON c.mz = peaks.mz AND k = 1""")
def nearest_mass(spark, sf_dir):
    return J.nearest(peaks(spark, sf_dir), references(spark, sf_dir), "mz", "mass", "ref_id", 50.0).select("mz", "ref_id", r("ppm_error", 4))


@query("""WITH m AS (SELECT p_partkey, 'InChIKey=' || upper(p_brand) AS k FROM part), d AS (SELECT k, min(s_suppkey) AS dbid FROM (SELECT s_suppkey, 'BRAND#' || s_suppkey % 30 AS k FROM supplier) GROUP BY 1)
SELECT p_partkey, dbid FROM m LEFT JOIN d ON d.k = replace(m.k, 'InChIKey=', '')""")
def database_join(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("InChIKey="), F.upper("p_brand")).alias("inchi_key"))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dbid"), F.concat(F.lit("brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("inchikey"), F.col("s_suppkey").alias("entry"))
    return J.attach_database(m, d.drop("entry").withColumn("name", F.col("dbid")), identifier="dbid").select("p_partkey", "dbid")


@query(f"WITH {PEAKS}, {REFS} SELECT mz, ref_id FROM peaks JOIN refs ON mass BETWEEN mz - mz * 120 / 1e6 AND mz + mz * 120 / 1e6")
def ppm_range_match(spark, sf_dir):
    return J.within_ppm(peaks(spark, sf_dir), references(spark, sf_dir), "mz", "mass", 120.0).select("mz", "ref_id")


@query(f"WITH {PEAKS} SELECT mz, round(mz - 22.989769, 6) AS na, round(mz - 18.033823, 6) AS nh4 FROM peaks")
def adduct_masses(spark, sf_dir):
    a = peaks(spark, sf_dir).withColumn("a", J.adduct_masses(F.col("mz")))
    return a.select("mz", F.round(F.get("a", F.lit(0)), 6).alias("na"), F.round(F.get("a", F.lit(3)), 6).alias("nh4"))


@query("""WITH a AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t FROM part), f AS (SELECT p_type AS name, avg(p_size) / 50 AS fraction FROM part GROUP BY 1 UNION ALL SELECT p_brand, avg(p_size) / 50 FROM part GROUP BY 1),
x AS (SELECT k, b, t, (SELECT fraction FROM f WHERE name = b) AS fb, (SELECT fraction FROM f WHERE name = t) AS ft FROM a) SELECT k, CASE WHEN fb > 0.51 THEN b WHEN ft > 0.51 THEN t ELSE b || ',' || t END AS chosen FROM x""")
def abundance_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("k"), F.array("p_brand", "p_type").alias("names"))
    f = p.groupBy(F.col("p_type").alias("name")).agg((F.avg("p_size") / 50).alias("fraction")).unionByName(p.groupBy(F.col("p_brand").alias("name")).agg((F.avg("p_size") / 50).alias("fraction")))
    return J.first_abundant(a, f, "k", "names", "name", "fraction", 0.51).select("k", "chosen")


@query("SELECT name, CAST(len(list(DISTINCT k)) AS BIGINT) AS n, min(k) AS first FROM (SELECT p_partkey AS k, unnest([p_brand, p_type]) AS name FROM part) GROUP BY 1")
def annotation_index(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array("p_brand", "p_type").alias("names"))
    return J.inverted_index(a, "k", "names", "name").select("name", F.size("keys").cast("long").alias("n"), F.get("keys", F.lit(0)).alias("first"))


@query(f"WITH {MOL}, {PROPS} SELECT name, class, CAST(carbons AS BIGINT) AS carbons, CAST(unsaturation AS BIGINT) AS unsaturation, round(unsaturation / nullif(carbons, 0), 6) AS unsaturation_share FROM props")
def molecule_properties(spark, sf_dir):
    m = N.molecule_properties(molecules(spark, sf_dir), "name")
    return m.select("name", "class", n("carbons"), n("unsaturation"), r("unsaturation_share"))


@query(f"WITH {MOL}, {PROPS} SELECT name, coalesce(nullif(regexp_extract(class, '^LP([CSEGIA])( O-)?$', 1), ''), nullif(regexp_extract(class, '^P([CSEGIA])( O-)?$', 1), '')) AS head FROM props")
def headgroup_letter(spark, sf_dir):
    return molecules(spark, sf_dir).select("name", N.head_group(N.lipid_class(F.col("name"))).alias("head"))


@query(rf"WITH {MOL} SELECT name, coalesce(nullif(regexp_extract(name, '^([A-Za-z0-9]+(\s?O)?)[\s-]', 1), ''), split_part(name, ' ', 1)) AS class FROM mol")
def short_classes(spark, sf_dir):
    return molecules(spark, sf_dir).select("name", N.short_class(F.col("name")).alias("class"))


@query("""WITH t AS (SELECT p_partkey, p_brand || '; ' || p_type || ';O2;x' AS s FROM part) SELECT p_partkey, array_to_string(list_transform(string_split(replace(s, ';O2', '#O2'), ';'), lambda x: trim(replace(x, '#O2', ';O2'))), ',') AS parts FROM t""")
def protected_split(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("; "), "p_type", F.lit(";O2;x")).alias("s"))
    return t.select("p_partkey", F.array_join(N.protected_split(F.col("s")), ",").alias("parts"))


@query(f"WITH {PEAKS} SELECT mz, printf('%.6f', mz) AS mz_key, md5(printf('%.6f', mz)) AS checksum FROM peaks")
def mz_keys(spark, sf_dir):
    return peaks(spark, sf_dir).select("mz", N.mz_key(F.col("mz")).alias("mz_key"), N.checksum(N.mz_key(F.col("mz"))).alias("checksum"))


CHAIN = ", ".join(f"('{a}', '{b}')" for a, b in G.SAME_CHAIN)
NEVER = ", ".join(f"('{a}', '{b}')" for a, b in G.NEVER)
NAMED = ", ".join(f"('{a}', '{b}', '{','.join(e)}')" for (a, b), e in ENZYMES)


@query(f"""WITH {MOL}, {PROPS}, h AS (SELECT *, coalesce(nullif(regexp_extract(class, '^LP([CSEGIA])( O-)?$', 1), ''), nullif(regexp_extract(class, '^P([CSEGIA])( O-)?$', 1), '')) AS head, class LIKE 'LP%' AS lyso FROM props),
e(a, b, enzyme) AS (VALUES {NAMED}) SELECT x.name AS reagent, y.name AS product, coalesce(enzyme, 'Unknown') AS enzymes FROM h x JOIN h y ON (x.head = y.head AND x.lyso <> y.lyso) OR (x.class = 'LPC' AND y.class = 'LPC' AND y.carbons > x.carbons) OR ((x.class, y.class) IN ({CHAIN}) AND x.carbons = y.carbons AND x.unsaturation = y.unsaturation)
LEFT JOIN e ON e.a = x.class AND e.b = y.class WHERE (x.class, y.class) NOT IN ({NEVER})""")
def reaction_network(spark, sf_dir):
    enzymes = spark.createDataFrame([(a, b, e) for (a, b), e in ENZYMES], "reagent_class string, product_class string, enzyme array<string>")
    net = G.reaction_network(N.molecule_properties(molecules(spark, sf_dir), "name"), enzymes)
    return net.select("reagent", "product", F.array_join("enzyme", ",").alias("enzymes"))


@query(f"WITH {MOL}, {PROPS}, c(class, color) AS (VALUES ('PC', '#aa0000'), ('PE', '#00aa00'), ('SM', '#0000aa')) SELECT name, coalesce(color, 'gray') AS color FROM props LEFT JOIN c ON c.class = props.class")
def molecule_colors(spark, sf_dir):
    c = spark.createDataFrame([("PC", "#aa0000"), ("PE", "#00aa00"), ("SM", "#0000aa")], "class string, color string")
    return N.molecule_properties(molecules(spark, sf_dir), "name", c).select("name", "color")


@query(f"WITH {MOL}, {PROPS} SELECT class, CAST(count(*) AS BIGINT) AS n, min(name) AS first FROM props GROUP BY 1")
def class_counts(spark, sf_dir):
    return N.molecule_properties(molecules(spark, sf_dir), "name").groupBy("class").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query(f"WITH {MOL} SELECT name, regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM mol")
def safe_file_names(spark, sf_dir):
    return molecules(spark, sf_dir).select("name", N.safe_file_name(F.col("name")).alias("file"))
