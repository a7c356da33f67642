"""Benchmark decontamination: a broadcast set of benchmark n-grams, token windows of the documents, exact verification.

Documents are cut into words once.  A window is a candidate if the hash of its first and last word is in a bitmap
(a constant made from the benchmark, of a bounded size); candidates carry their whole n-gram and are joined with the set
on string equality, so hits are exact.  The set is broadcast behind a check of its size; beyond the bound the candidates
are joined with it by a shuffle.  A benchmark of any size gets a bitmap: beyond MAX_BITS / 8 windows it is denser and
lets more candidates through, that is all.  Nothing but ids and candidates is shuffled.

Defined cases: a null text has no words; an item of fewer than n words, but not none, is one window; an item without an
id marks words but is not listed; repeated rows are judged each for itself; empty tables give empty or clean results;
extra columns pass through `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, cols, fresh, literal_array, spool

N = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most windows of the benchmark that are broadcast, and most bits of the bitmap (a power of two).
MAX_BROADCAST, MAX_BITS = 2_000_000, 1 << 26


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram_at(words: Column, at: Column, k: int) -> Column:
    return F.array_join(F.slice(words, at + 1, k), " ")


def benchmark_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, k (its words), ends (hash of first and last word), items (ids of the items that hold it)."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    k = F.least(F.size("words"), F.lit(n))
    at = words.select("item_id", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.slice("words", i + 1, k))).alias("window"))
    flat = at.select("item_id", "k", F.array_join("window", " ").alias("gram"), F.xxhash64(F.element_at("window", 1), F.element_at("window", -1), F.col("k").cast("int")).alias("ends"))
    return flat.groupBy("gram", "k", "ends").agg(F.collect_set("item_id").alias("items"))


def _bitmap(windows: DataFrame, count: int) -> tuple[Column, int]:
    """A bit for each hash of ends, 32 bits a window as long as MAX_BITS allows; its cells of 64 bits reach the driver."""
    bits = 1024
    while bits < 32 * count and bits < MAX_BITS:
        bits *= 2
    at = F.col("ends").bitwiseAND(F.lit(bits - 1))
    set_ = F.expr("1L").alias("one")
    words = windows.select(F.shiftright(at, 6).cast("int").alias("cell"), at.bitwiseAND(F.lit(63)).cast("int").alias("place"), set_)
    found = words.groupBy("cell").agg(F.bit_or(F.call_function("shiftleft", "one", "place")).alias("word"))
    cells = [0] * (bits // 64)
    for r in found.collect():
        cells[r["cell"]] = r["word"]
    return literal_array(cells, "long"), bits


def _candidates(words: Column, k: int, bitmap: tuple[Column, int]) -> Column:
    """pos, k, gram of the windows of k words that may be in the set."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    cells, bits = bitmap

    def maybe(i: Column) -> Column:
        at = F.xxhash64(F.get(words, i), F.get(words, i + (k - 1)), F.lit(k)).bitwiseAND(F.lit(bits - 1)).cast("int")
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get(cells, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63)))) == 1

    starts = F.filter(starts, maybe)
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), gram_at(words, i, k).alias("gram")))


def find_hits(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, n_words, n_hit, item_ids (strings, sorted), spans (word positions and lengths)."""
    windows = spool(benchmark_windows(items, n))
    count = windows.count()
    lengths = [r[0] for r in windows.select("k").distinct().collect()]  # n at most
    bitmap = _bitmap(windows, count)
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    none = F.array().cast("array<struct<pos:int,k:int,gram:string>>")
    found = F.concat(none, *(_candidates(F.col("words"), k, bitmap) for k in sorted(lengths)))
    flat = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), F.explode_outer(found).alias("at"))
    flat = flat.select("row", "id", "n_words", F.col("at.pos").alias("pos"), F.col("at.gram").alias("gram"))
    known = windows.select("gram", "k", "items")
    joined = flat.join(F.broadcast(known) if count <= MAX_BROADCAST else known, "gram", "left")
    spans = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("pos", "k"))))
    grouped = joined.groupBy("row", "id", "n_words").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))).cast("array<string>")).alias("item_ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a.end, s.pos + s.k).alias("end"), (a.n + F.greatest(F.lit(0), s.pos + s.k - F.greatest(a.end, s.pos))).alias("n")),
        lambda a: a.n.cast("long"),
    )
    return grouped.select("row", "id", "n_words", covered.alias("n_hit"), "item_ids", "spans")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words stand in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows ("documents"), or with the hit words cut out of those rows ("spans")."""
    row = fresh(docs, "_row")
    # written once: a second scan may be split otherwise and would number other rows
    numbered = spool(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = find_hits(numbered, items, n, id_col, text_col, row).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = spool(hits.select(F.col("row").alias(row), F.col("spans").alias("_spans")))
    small = bad.count() <= MAX_BROADCAST
    if mode == "documents":
        keys = bad.select(row)
        return numbered.join(F.broadcast(keys) if small else keys, row, "left_anti").select(cols(docs.columns))
    spans = fresh(docs, "_spans")
    bad = bad.select(row, F.col("_spans").alias(spans))
    text = F.col(text_col)
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)
    held = F.transform(words, lambda w, i: F.when(F.exists(F.col(spans), lambda s: (i >= s.pos) & (i < s.pos + s.k)), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(held, ""))
    joined = numbered.join(F.broadcast(bad) if small else bad, row, "left")
    return joined.select(*(F.when(F.col(spans).isNull(), text).otherwise(cut).alias(text_col) if c == text_col else col(c) for c in docs.columns))
