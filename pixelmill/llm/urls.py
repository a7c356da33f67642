"""URL filters: a list of host and path rules as one sorted array of 64-bit xxhash keys that tasks map into memory.

A rule `host` + `path` (like `example.com/en/`) fits its host and all subdomains where the url's path starts with the
rule's path; the longest rule that fits decides, and where none fits the default verdict holds.  The keys that could
fit a url are few: its host's suffixes times the prefixes of its path that are as long as some rule's path.  Their
digests are probed by one vectorised binary search a batch, and each digest that is met is confirmed by the stored
string, so collisions decide nothing.

The list goes to executors as a file of the shared folder (Spark fetches it once an executor, also for new ones) behind
a check of its size; a list beyond MAX_BYTES is joined by key instead, hot keys apart.

Defined cases: a url that is null or has no `://` has an empty host and path, which no rule fits; a rule without a host
is an error; of rules of equal length that fit
the one with the longer host holds, of equal rules with different verdicts "block"; repeated urls are judged each for itself; empty
tables give empty results or default verdicts; kept columns under a name of the result raise ValueError, others do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.base import lookup

from .common import ascii_lower, col, extended, require_free, shelved, ship, spool

#: Most bytes of a list (its strings and 17 bytes a rule) that are shipped as a file.
MAX_BYTES = 256 << 20
FOUND = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a url; both empty where it is null or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


@dataclass(frozen=True)
class UrlList:
    #: key (host and path), verdict: each rule once, written in the shared folder.
    table: DataFrame
    count: int
    #: Most labels of a host, and the lengths of all paths: what a url has to be probed for.
    labels: int
    lengths: tuple[int, ...]
    #: Name of the file that executors map, or None for a list that is joined.
    name: str | None


def _file(digests: np.ndarray, verdicts: np.ndarray, keys: list[bytes]) -> bytes:
    """count, sorted digests, where each string ends, verdicts, strings."""
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    return b"".join((np.int64(len(keys)).tobytes(), digests.astype(np.int64).tobytes(), ends.tobytes(), verdicts.astype(np.uint8).tobytes(), *keys))


class Mapped:
    """A list's file, mapped: nothing is read but the pages that searches touch."""

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(whole[:8].view(np.int64)[0])
        self.digests, self.ends = whole[8:8 + 8 * n].view(np.int64), whole[8 + 8 * n:8 + 16 * n].view(np.int64)
        self.verdicts, self.strings = whole[8 + 16 * n:8 + 17 * n], whole[8 + 17 * n:]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0:int(self.ends[i])].tobytes()

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the digests that the array holds, and the first place in the array of each."""
        if not len(self.digests) or not len(digests):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.digests, digests)
        met = np.flatnonzero(self.digests[np.minimum(place, len(self.digests) - 1)] == digests)
        return met, place[met]

    def confirmed(self, place: int, digest: int, key: bytes) -> int:
        """The rule that is this very string among those of one digest, or -1."""
        while place < len(self.digests) and self.digests[place] == digest:
            if self.string(place) == key:
                return place
            place += 1
        return -1


def build(rules: DataFrame, host_col: str = "host", path_col: str = "path", verdict_col: str = "verdict", max_bytes: int = MAX_BYTES) -> UrlList:
    """The list of rules (host, path, verdict "allow" or "block"; a null path is empty)."""
    host, path = ascii_lower(F.col(host_col)), F.coalesce(F.col(path_col), F.lit(""))
    cut = rules.select(host.alias("host"), path.alias("path"), F.col(verdict_col).alias("verdict"))
    if cut.where("host IS NULL OR host = '' OR verdict IS NULL OR verdict NOT IN ('allow', 'block') OR (path <> '' AND NOT startswith(path, '/'))").limit(1).count():
        raise ValueError("a rule needs a host, a path that is empty or starts with /, and the verdict allow or block")
    key = F.concat("host", "path")
    # "block" is the greater string
    table = spool(cut.groupBy(key.alias("key"), F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("length")).agg(F.max("verdict").alias("verdict")))
    count, labels, size = table.agg(F.count("*"), F.max("labels"), F.sum(F.octet_length("key"))).first()
    lengths = tuple(sorted(r[0] for r in table.select("length").distinct().collect()))  # no more than the longest path has characters
    name = None
    if (size or 0) + 17 * count + 8 <= max_bytes:
        held = table.select("key", F.xxhash64("key").alias("digest"), (F.col("verdict") == "block").alias("block")).orderBy("digest", "key").toArrow()
        keys = [k.encode() for k in held["key"].to_pylist()]
        name = ship(rules.sparkSession, [_file(held["digest"].to_numpy(), held["block"].to_numpy(), keys)])
    return UrlList(table.select("key", "verdict"), count, labels or 0, lengths, name)


def candidates(host: Column, path: Column, known: UrlList) -> Column:
    """The keys that could fit, each suffix of the host with each prefix of the path that is as long as some rule's."""
    labels = F.split(host, "\\.")
    first = F.greatest(F.size(labels) - known.labels, F.lit(0))
    hosts = F.transform(F.sequence(first, F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, known.lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    every = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def judge(pages: DataFrame, known: UrlList, keep: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns `keep` of pages, host, path, rule (the longest that fits, else null) and verdict of each row."""
    require_free(keep, FOUND)
    plain, put, back = shelved(keep)
    host, path = host_and_path(col(url_col))
    cut = pages.select(*put, host.alias("host"), path.alias("path"))
    if not known.count:
        return cut.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    probed = cut.withColumn("_keys", candidates(F.col("host"), F.col("path"), known))
    if known.name is None:
        return _joined(probed, known, default).select(*back, *FOUND)
    probed = probed.withColumn("_digests", F.transform("_keys", lambda k: F.xxhash64(k)))
    name, n_keep, names = known.name, len(keep), [*plain, *FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Mapped(SparkFiles.get(name))
        for batch in batches:
            keys, digests = batch.column(n_keep + 2), batch.column(n_keep + 3)
            flat = digests.flatten().to_numpy()
            met, place = held.probe(flat)
            of_row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy())
            rules: list[str | None] = [None] * batch.num_rows
            verdicts = [default] * batch.num_rows
            for row, digest, at, key in zip(of_row[met].tolist(), flat[met].tolist(), place.tolist(), keys.flatten().take(pa.array(met)).to_pylist()):
                if rules[row] is not None and len(key) <= len(rules[row]):
                    continue
                rule = held.confirmed(at, digest, key.encode())
                if rule >= 0:
                    rules[row], verdicts[row] = key, "block" if held.verdicts[rule] else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep + 2], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=names)

    return probed.mapInArrow(run, extended(cut, "rule string, verdict string")).select(*back, *FOUND)


def _joined(probed: DataFrame, known: UrlList, default: str) -> DataFrame:
    """For a list too large to ship: candidates meet the rules by key, common ones apart from the rest."""
    rows = spool(probed.withColumn("_row", F.monotonically_increasing_id()))
    keys = rows.select("_row", F.explode("_keys").alias("key"))
    best = lookup(keys, "key", known.table).groupBy("_row").agg(F.max(F.struct(F.length("key"), F.length(F.substring_index("key", "/", 1)), "key", "verdict")).alias("_best"))
    return rows.join(best, "_row", "left").select(*(c for c in probed.columns if c != "_keys"), F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, known: UrlList, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages whose url is allowed, all columns as they are."""
    _, put, back = shelved(pages.columns)
    whole = pages.select(col(url_col).alias("_url"), F.struct(*put).alias("_all"))
    return judge(whole, known, ["_all"], "_url", default).where("verdict = 'allow'").select("_all.*").select(*back)
