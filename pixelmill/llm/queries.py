"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, covertree, decontam, importance, licenses, lm, pii, quality, sharding, simhash, trie, urls
from .common import held_out, table


def op1_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bw),
dk AS (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM dk),
h AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "license", "coverage", "first_word", "end_word", F.array_join("licenses", ",").alias("licenses"),
        F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["license"], c["first_word"], c["end_word"])), ",").alias("copies"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text"), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "text")
    model = lm.fit(docs.where("NOT held_out"))
    scored = lm.score(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.segments(rows.unionByName(added)))


#: (host, path, verdict) of the rules that op11 applies: the query's fixed values.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = urls.build(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return urls.judge(table(spark, sf_dir, "pages"), known, ["page_id"])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_prefixes_of_rebuilt(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m(control) AS (VALUES ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<|'), ('|>'), ('\')),
f AS (SELECT *, length(text) + (SELECT sum((length(text) - length(replace(text, control, ''))) // length(control)) FROM m)
+ CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + length(role) END AS chars,
CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars, regexp_full_match(string_agg(code, '' ORDER BY turn, role, text), 's?(ua)+') AS ordered
FROM f GROUP BY conv_id
"""

OP11_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark, row_number() OVER () AS n FROM pages),
r AS (SELECT page_id, n, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, n, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM r),
p AS (SELECT page_id, n, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
l(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (SELECT page_id, n, host, path, rule_host || rule_path AS rule, verdict FROM p LEFT JOIN l ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict FROM j GROUP BY page_id, n, host, path
"""

#: A crc32 by its table of 256 entries, made here from the polynomial; c.tab is that table.
CRC_TABLE = "c AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of the UTF-8 bytes of `text`, beside c."""
    number = f"list_transform(range(1, CAST(length(hex({text})) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {number}), lambda a, b: xor(a >> 8, c.tab[(xor(a, b) & 255) + 1])), 4294967295)"


OP12_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
dg AS (SELECT n, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT n, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, k WHERE len(w) >= k)),
bg AS (SELECT array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM b, k WHERE len(w) >= k)),
g AS (SELECT gram, {_crc("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM (SELECT gram FROM dg UNION ALL SELECT gram FROM bg)), c),
s AS (SELECT bucket, count(*) AS s FROM dg JOIN g USING (gram) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bg JOIN g USING (gram) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sum(coalesce(s, 0)) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1.0::DOUBLE) * (sum(coalesce(t, 0)) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT n, count(*) AS n_features, sum(gain) AS weight FROM dg JOIN g USING (gram) JOIN gain USING (bucket) GROUP BY n),
h AS (SELECT n, doc_id, len(w) AS words, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d),
v AS (SELECT n, doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN w USING (n)),
o AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n) AS rank, count(*) OVER () AS total FROM v WHERE words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 5 * total // 100 THEN CAST(rank AS BIGINT) END AS rank FROM v LEFT JOIN o USING (n)
"""

OP13_SQL = f"""
WITH {CRC_TABLE},
a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, sha256(length(role) || ':' || role || ':' || text) AS mark, octet_length(encode(text)) AS bytes, turn FROM a),
p AS (SELECT conv_id, mark, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM m),
i AS (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM a), c),
r AS (SELECT i.conv_id, 0 AS part, pos, mark, bytes FROM i JOIN p ON p.conv_id = i.base AND pos <= h UNION ALL SELECT i.conv_id, 1, pos, mark, bytes FROM i JOIN p ON p.conv_id = i.conv_id AND pos > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY part, pos) AS key, bytes FROM r
UNION ALL SELECT conv_id, 0, '', 0 FROM i),
z AS (SELECT conv_id, max(depth) AS last FROM s GROUP BY conv_id),
n AS (SELECT key, depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM s JOIN z ON s.conv_id = z.conv_id GROUP BY key, depth),
k AS (SELECT n.key, count(b.key) AS n_children FROM n LEFT JOIN n b ON b.depth = n.depth + 1 AND starts_with(b.key, n.key) GROUP BY n.key),
t AS (SELECT n.key, count(*) FILTER (n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens FROM n JOIN n b ON starts_with(b.key, n.key) JOIN k ON k.key = b.key GROUP BY n.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k ON k.key = n.key JOIN t ON t.key = n.key LEFT JOIN n up ON up.depth = n.depth - 1 AND starts_with(n.key, up.key)
"""

QUERIES = {f.__name__: f for f in (op1_sampled_sharding, op2_benchmark_decontamination, op3_license_scan, op4_quality_classifier, op5_cover_tree_near_dedup, op6_byte_bpe, op7_suffix_tree_scores, op8_bootstrapped_pii, op9_simhash_near_dedup, op10_chat_formatting, op11_url_filter, op12_importance_resampling, op13_conversation_trie)}
ORACLE_SQL = {"op2_benchmark_decontamination": OP2_SQL, "op5_cover_tree_near_dedup": OP5_SQL, "op10_chat_formatting": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_conversation_trie": OP13_SQL}
