"""Target-distribution importance resampling: hashed runs of 1 to 3 words, gains of a target over the corpus, Gumbel keys.

Higher-order functions make the bucket array of each whole document; it is written once and read twice: for the totals
(the one thing of the texts that is shuffled: a row a bucket and task) and for the weights, which add up elements of a
literal array of BUCKETS gains.  The draw looks at small rows only: a histogram of scores finds what may be drawn, those
rows alone are put into ranges of the score and numbered there.

Defined cases: a null text has no words, so weight 0; rows without an id draw by the key of an empty id; repeated rows
are rows of their own; ties of the score go to the smaller id (null first), then to the earlier row; an empty corpus or
target counts nothing; extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.base import ordered_index

from .common import col, cols, literal_array, spool
from .decontam import words_of

BUCKETS, RUN, LEAST_WORDS = 10_000, 3, 20
#: Cells of the histogram that finds the scores that may be drawn.
CELLS = 4096


def bucket_array(words: Column, buckets: int = BUCKETS, run: int = RUN) -> Column:
    """The bucket of each run of 1 to `run` consecutive words, repeats included."""
    def of(k: int) -> Column:
        def bucket(w: Column, i: Column) -> Column:
            gram = F.concat_ws(" ", w, *(F.get(words, i + j) for j in range(1, k)))
            return (F.crc32(gram.cast("binary")) % buckets).cast("int")
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))), bucket)

    return F.concat(*(of(k) for k in range(1, run + 1)))


def bucketed(texts: DataFrame, keep: list[str], text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """The columns `keep`, n_words and buckets of each row of texts."""
    words = texts.select(*cols(keep), words_of(col(text_col).cast("string")).alias("_words"))
    return words.select(*cols(keep), F.size("_words").cast("long").alias("n_words"), bucket_array(F.col("_words"), buckets, run).alias("buckets"))


def totals(arrays: DataFrame) -> dict[int, int]:
    """Features in each bucket: a row a bucket and task is shuffled, a row a bucket reaches the driver."""
    found = arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    return {r["bucket"]: r["count"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of how much likelier a feature of each bucket is in the target than in the corpus, smoothed by one."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weight(gain: list[int]) -> Column:
    table = literal_array(gain, "long")
    return F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number that depends on the id and the seed only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, share: float, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3... by falling score for the floor(share * N) highest of
    the N rows of at least `least_words` words, else null.  scored must be written (it is read several times)."""
    usable = F.col("n_words") >= least_words
    n, low, high = scored.where(usable).agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = math.floor(share * n / 100)
    null = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", null)
    cell = F.floor((F.col("score") - low) / F.lit((high - low + 1) / CELLS)).cast("int")
    sizes = scored.where(usable).groupBy(cell.alias("cell")).count().collect()
    above, least = 0, 0
    for r in sorted(sizes, reverse=True):
        above, least = above + r["count"], r["cell"]
        if above >= wanted:
            break
    may = usable & (cell >= least)
    numbered = scored.where(may).withColumns({"_down": -F.col("score"), "_row": F.monotonically_increasing_id()})
    rank = F.when(F.col("_at") < wanted, F.col("_at") + 1).cast("long").alias("rank")
    ranked = ordered_index(numbered, ["_down", "doc_id", "_row"], "_at").select(*cols(scored.columns), rank)
    return scored.where(~may).select("*", null).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, share: float = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of each row of docs; rank is null where it is not drawn."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    arrays = spool(bucketed(rows, ["doc_id"]))
    gain = gains(totals(arrays), totals(bucketed(target, [], target_col)))
    weighed = arrays.select("doc_id", F.size("buckets").cast("long").alias("n_features"), "n_words", weight(gain).alias("weight"))
    return draw(spool(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))), share)


def selected(docs: DataFrame, target: DataFrame, share: float = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is drawn."""
    drawn = resample(docs, target, share, seed, id_col, text_col).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")
