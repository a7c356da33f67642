"""Byte-level BPE by overlapping chunks: pre-tokenise chunks apart, stitch them where pre-token boundaries meet again,
then encode the pieces; decoding concatenates the bytes of the ids.

The pattern has no look-behind, so what follows a boundary does not depend on what stands before it: once two chunks
share a boundary they agree from there on.  A piece is final if it ends before its chunk does.  Texts of one chunk are
encoded where they are.  The chunks of longer ones are rows, dealt to tasks by text and number: each is pre-tokenised and
encoded up to the boundary that it shares with the next one, and a text's ids are then put together from its chunks.  If
an overlap holds no common boundary (one long run of letters, say), the text is gone through in one task, where the
earlier chunk is cut again, longer, from its last final boundary.  Only chunks of long texts are shuffled.

Defined cases: null is the empty text with no ids; repeated rows and extra columns do not matter, but columns that
are kept under a name of the result raise ValueError; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, require_free, shelved

#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A pre-token is settled once so many characters behind its start are known and one behind its end (the longest fixed
#: alternative of the pattern).
LOOK = 3
#: Pieces whose ids a worker remembers.
CACHE = 400_000
#: Rows of a record batch that are encoded before a batch goes back.
ROWS = 512


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _class(pattern: str, top: int) -> str:
    """The code points below top that a one-character pattern matches for the library, as the inside of a character class."""
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    # what the pattern does not match has no ids
    points = "".join(chr(c) for c in range(top) if not 0xD800 <= c < 0xE000)
    matched = np.array([ord(c) for c in probe.decode_bytes(probe.encode_ordinary(points)).decode()])
    cuts = np.flatnonzero(np.diff(matched) != 1) + 1
    return "".join(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}" for run in np.split(matched, cuts))


def compiled(pattern: str, top: int = 0x110000) -> re.Pattern:
    """pattern for the standard library, with its Unicode classes (below top) spelled out."""
    inner = {token: _class(token, top) for token in (r"\p{L}", r"\p{N}", r"\s")}
    space = inner[r"\s"]
    out, depth, at = [], 0, 0
    while at < len(pattern):
        if pattern.startswith(r"\S", at):
            out.append(f"[^{space}]")
            at += 2
            continue
        token = next((t for t in inner if pattern.startswith(t, at)), None)
        if token:
            out.append(inner[token] if depth else f"[{inner[token]}]")
            at += len(token)
            continue
        depth += {"[": 1, "]": -1}.get(pattern[at], 0)
        out.append(pattern[at])
        at += 1
    return re.compile("".join(out))


def finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of pattern, by tables of 16 bits for texts that have no higher code points."""
    low, high = compiled(pattern, 0x10000).findall, compiled(pattern).findall

    def find(text: str) -> list[str]:
        return (low if len(text.encode("utf-16-le")) == 2 * len(text) else high)(text)

    return find


def pieces_of(text: str, find: Callable[[str], list[str]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of text, in lists that follow each other."""
    if len(text) <= chunk + overlap:
        yield find(text)
        return
    start = 0  # a boundary of the whole text from which nothing has been given yet
    pieces = find(text[:chunk + overlap])
    end = chunk + overlap
    while end < len(text):
        bounds = list(accumulate(map(len, pieces), initial=start))
        final = bounds[:bisect_right(bounds, end - LOOK)]  # what comes behind the chunk can change the later ones
        mine = min(end - overlap, len(text))
        after = find(text[mine:mine + chunk + overlap])
        theirs = set(accumulate(map(len, after), initial=mine)) - {mine + min(chunk + overlap, len(text) - mine)}
        meet = next((i for i, b in enumerate(final) if b > mine and b in theirs), None)
        if meet is None:  # no common boundary: go on from the last final one
            yield pieces[:len(final) - 1]
            start = final[-1]
            length = max(chunk, 2 * (end - start)) + overlap
            pieces, end = find(text[start:start + length]), start + length
            continue
        yield pieces[:meet]
        start = final[meet]
        ends = accumulate(map(len, after), initial=mine)
        pieces = after[next(i for i, b in enumerate(ends) if b == start):]
        end = mine + chunk + overlap
    yield pieces


class Codec:
    """Encodes and decodes whole texts; ids are bytes, four (little-endian, unsigned) for each."""

    def __init__(self, ranks: dict[bytes, int], find: Callable[[str], list[str]], chunk: int = CHUNK, overlap: int = OVERLAP):
        # all of a piece is one match: the library merges it by ranks
        single = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = array("I", single(piece)).tobytes()
                if len(self) < CACHE:
                    self[piece] = ids
                return ids

        self.ids_of = Pieces().__getitem__
        self.bytes_of = {i: b for b, i in ranks.items()}.__getitem__
        self.find, self.chunk, self.overlap = find, chunk, overlap

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.ids_of, pieces)) for pieces in pieces_of(text, self.find, self.chunk, self.overlap))

    def chunk_of(self, text: str, last: bool) -> tuple[bytes, list[int], list[int], int | None]:
        """Of a chunk (with the overlap behind it, if it is not the last): its ids up to where it meets the next chunk,
        the boundaries in its first characters, how many ids stand before each, and where it meets the next chunk (from
        that one's start; None if nowhere)."""
        pieces = self.find(text)
        bounds = list(accumulate(map(len, pieces), initial=0))
        stop, meet = len(bounds) - 1, None
        if not last:
            known = len(text) - LOOK
            theirs = {b for b in accumulate(map(len, self.find(text[self.chunk:])), initial=self.chunk) if b <= known}
            final = bisect_right(bounds, known)
            stop = next((i for i in range(bisect_right(bounds, self.chunk - 1), final) if bounds[i] in theirs), None)
            if stop is None:
                return b"", [], [], None
            meet = bounds[stop] - self.chunk
        ids = [self.ids_of(p) for p in pieces[:stop]]
        head = min(stop, bisect_right(bounds, self.overlap) - 1) + 1
        return b"".join(ids), bounds[:head], list(accumulate((len(i) // 4 for i in ids[:head - 1]), initial=0)), meet

    def stitched(self, chunks: list[tuple[str, bytes, list[int], list[int], int | None]]) -> bytes:
        """The ids of a text from its chunks in order: (text without the overlap, and what chunk_of gives)."""
        if any(meet is None for *_, meet in chunks[:-1]):
            return self.encode("".join(text for text, *_ in chunks))
        out, begin = [], 0
        for _, ids, bounds, before, meet in chunks:
            out.append(ids[4 * before[bounds.index(begin)]:])
            begin = meet
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of, np.frombuffer(ids, dtype="<u4").tolist()))


def _over(docs: DataFrame, path: str, pattern: str, columns: list[str], row: Callable[[Codec, bytes], tuple], schema: pa.Schema, ddl: str, text_col: str) -> DataFrame:
    """columns of docs and what `row` makes of the ids of each text."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary's size is fixed
    find = finder(pattern)
    require_free(columns, schema.names)
    columns, put, back = shelved(columns)
    kept = docs.select(*put)
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, find)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = list(zip(*(row(codec, codec.encode(t or "")) for t in part.column(width).to_pylist())))
                yield pa.RecordBatch.from_arrays(part.columns[:width] + [pa.array(v, f.type) for v, f in zip(found, schema)], names=columns + schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (number, text) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())):
                starts = range(0, max(1, len(text) - OVERLAP), CHUNK)
                for no in range(0, len(starts), 16):  # a few chunks at once: their text is held twice
                    some = starts[no:no + 16]
                    own = [pa.array([number] * len(some), pa.int64()), pa.array(range(no, no + len(some)), pa.int64()), pa.array([s == starts[-1] for s in some]), pa.array([text[s:s + CHUNK + OVERLAP] for s in some])]
                    yield pa.RecordBatch.from_arrays([c.take(pa.array([i] * len(some))) for c in batch.columns[:width]] + own, names=[*columns, "_row", "_no", "_last", "_text"])

    halves = pa.schema([("_ids", pa.binary()), ("_bounds", pa.list_(pa.int32())), ("_before", pa.list_(pa.int32())), ("_meet", pa.int32())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, find)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                texts, last = part.column(width + 3).to_pylist(), part.column(width + 2).to_pylist()
                found = list(zip(*(codec.chunk_of(t, end) for t, end in zip(texts, last))))
                own = pa.array([t if end else t[:CHUNK] for t, end in zip(texts, last)], pa.string())
                yield pa.RecordBatch.from_arrays(part.columns[:width + 2] + [own] + [pa.array(v, f.type) for v, f in zip(found, halves)], names=[*columns, "_row", "_no", "_text", *halves.names])

    def stitch(table: pa.Table) -> pa.Table:
        codec = Codec(ranks.value, find)
        table = table.sort_by("_no")
        ids = codec.stitched(list(zip(*(table.column(c).to_pylist() for c in ("_text", *halves.names)))))
        return pa.table([c[:1] for c in table.columns[:width]] + [pa.array([v], f.type) for v, f in zip(row(codec, ids), schema)], names=columns + schema.names)

    texts = docs.select(*put, F.col(text_col).cast("string").alias("_text"))
    long = F.coalesce(F.length("_text"), F.lit(0)) > CHUNK + OVERLAP
    short = texts.where(~long).mapInArrow(run, extended(kept, ddl))
    cuts = texts.where(long).select(*columns, F.monotonically_increasing_id().alias("_row"), "_text").mapInArrow(cut, extended(kept, "_row long, _no long, _last boolean, _text string"))
    dealt = cuts.repartition("_row", "_no").mapInArrow(chunks, extended(kept, "_row long, _no long, _text string, _ids binary, _bounds array<int>, _before array<int>, _meet int"))
    return short.unionByName(dealt.groupBy("_row").applyInArrow(stitch, extended(kept, ddl))).select(*back, *schema.names)


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs and ids (array of int) of each text."""
    def row(codec: Codec, ids: bytes) -> tuple:
        return (np.frombuffer(ids, dtype="<u4").astype(np.int32),)
    return _over(docs, path, pattern, columns, row, pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>", text_col)


def decode(encoded: DataFrame, path: str, columns: list[str], ids_col: str = "ids") -> DataFrame:
    """columns of encoded and text, decoded from its ids (bytes that are not UTF-8 become U+FFFD)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in ranks.value.items()}.__getitem__
        for batch in batches:
            texts = [b"".join(map(bytes_of, ids or ())).decode(errors="replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, "text"])

    require_free(columns, ["text"])
    columns, put, back = shelved(columns)
    return encoded.select(*put, F.col(ids_col).alias("__ids")).mapInArrow(run, extended(encoded.select(*put), "text string")).select(*back, "text")


def digests(docs: DataFrame, path: str, pattern: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns, n_tokens, ids_sha256 and decoded_sha256: each text encoded, its ids decoded again."""
    def row(codec: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _over(docs, path, pattern, columns, row, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)
