"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  Filters run over the bytes of a chunk (a table of weights
for each place and byte value, which is a convolution over one-hot bytes), are rectified and max-pooled; a linear layer
gives the chunk's logit, and the mean of the chunks' logits is the logit of the text.  Filters and layer are learned
together by Adam on a sample of labelled rows that is bounded by TRAIN_ROWS and TRAIN_SPANS.  Scoring is one pass with
no shuffle.

Defined cases: a null or empty text is one chunk of padding and gets the score learned for that; with no labelled row,
or rows of one label only, each score is the share of label 1 (0.5 with none); repeated rows score alike; empty tables
give empty results; extra columns do not matter, but the score's name must be free (else an error is raised).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cols, extended, fresh, held_out, shelved

#: Bytes of a chunk and from one chunk to the next; width, stride and number of the filters.
CHUNK, STEP, WIDTH, STRIDE, FILTERS = 256, 240, 6, 1, 16
#: Labelled rows that are learned from, at most (about; drawn by a hash of the id, half of each label).
TRAIN_ROWS = 3000
#: Spans of CHUNK bytes, spread evenly over all of it, that stand for a longer text in learning; scores read whole texts.
TRAIN_SPANS = 64
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 7
#: Longest of the short spans that are learned from besides whole texts, in bytes.
SPAN = 160
#: Chunks that are scored at once, to bound memory.
AT_ONCE = 512
THRESHOLD = 0.7


def chunks_of(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that cover text; the last one ends with it.  A short text is padded with zeros."""
    if len(text) <= CHUNK:
        row = np.zeros((1, CHUNK), dtype=np.uint8)
        row[0, :len(text)] = np.frombuffer(text, dtype=np.uint8)
        return row
    data = np.frombuffer(text, dtype=np.uint8)
    starts = np.append(np.arange(0, len(text) - CHUNK, STEP), len(text) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts]


@dataclass
class Net:
    table: np.ndarray  # WIDTH x 256 x FILTERS; byte 0 is padding and stays 0
    bias: np.ndarray
    weight: np.ndarray
    base: np.ndarray  # of one number

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        table[:, 0] = 0
        return cls(table, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def convolve(self, chunks: np.ndarray) -> np.ndarray:
        """chunks x places x FILTERS."""
        places = (CHUNK - WIDTH) // STRIDE + 1
        out = np.take(self.table[0], chunks[:, 0:places * STRIDE:STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.table[j], chunks[:, j:j + places * STRIDE:STRIDE], axis=0)
        return out

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        found = [np.maximum(self.convolve(chunks[at:at + AT_ONCE]).max(axis=1) + self.bias, 0) @ self.weight + self.base for at in range(0, len(chunks), AT_ONCE)]
        return np.concatenate(found)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        out, held, size = np.empty(len(texts)), [], 0
        first = 0
        for i, text in enumerate(texts):
            held.append(chunks_of(text))
            size += len(held[-1])
            if size >= AT_ONCE or i == len(texts) - 1:
                ends = np.cumsum([len(c) for c in held])
                sums = np.add.reduceat(self.logits(np.concatenate(held)).astype(np.float64), np.concatenate(([0], ends[:-1])))
                out[first:i + 1] = sums / np.diff(np.concatenate(([0], ends)))
                first, held, size = i + 1, [], 0
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Net:
    """Adam on the cross-entropy of whole texts.  Label 1 weighs THRESHOLD of the whole, so that a score at the threshold
    is equal evidence for both labels."""
    rng = np.random.default_rng(seed)
    net = Net.new(rng)
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or share in (0, 1):
        net.weight[:] = 0
        net.base[:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return net
    weights = np.where(labels == 1, THRESHOLD / share, (1 - THRESHOLD) / (1 - share))
    parameters = [net.table, net.bias, net.weight, net.base]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    # short texts are few but must be judged as well: a short random span of each text is learned from besides the whole
    cut = [chunks_of(t) for t in texts]
    for i, t in enumerate(texts):
        size = int(rng.integers(8, SPAN))
        if len(t) > size:
            at = int(rng.integers(0, len(t) - size))
            cut.append(chunks_of(t[at:at + size]))
            labels, weights = np.append(labels, labels[i]), np.append(weights, weights[i])
    places, step = np.arange(WIDTH), 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(cut))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            chunks = np.concatenate([cut[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(cut[r]) for r in rows])
            n = np.bincount(owner)
            best = np.empty((len(chunks), FILTERS), np.int64)
            top = np.empty((len(chunks), FILTERS), np.float32)
            for s in range(0, len(chunks), AT_ONCE):
                z = net.convolve(chunks[s:s + AT_ONCE])
                best[s:s + AT_ONCE] = z.argmax(axis=1)
                top[s:s + AT_ONCE] = z.max(axis=1)
            hidden = np.maximum(top + net.bias, 0)
            logit = np.bincount(owner, hidden @ net.weight + net.base) / n
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[rows]) * weights[rows] / len(rows)
            each = (error / n)[owner].astype(np.float32)
            back = each[:, None] * net.weight * (hidden > 0)
            # gradients reach the bytes under each filter's best place only
            seen = np.take_along_axis(chunks, (best[:, :, None] * STRIDE + places).reshape(len(chunks), -1), axis=1).reshape(len(chunks), FILTERS, WIDTH)
            flat = (places * 256 + seen) * FILTERS + np.arange(FILTERS)[None, :, None]
            table = np.bincount(flat.ravel(), np.repeat(back.ravel(), WIDTH), minlength=net.table.size).reshape(net.table.shape)
            table += 1e-5 * net.table
            table[:, 0] = 0
            step += 1
            for p, g, m, v in zip(parameters, (table, back.sum(axis=0), hidden.T @ each, np.array([each.sum()])), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """About `rows` labelled texts, half of each label as far as there are so many, never a held-out one."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("id"), 4))
    count = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    place = F.xxhash64(F.lit("train"), "id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    wanted = F.lit(False)
    for label, n in count.items():
        wanted |= (F.col("quality") == label) & (place < min(1.0, rows / 2 / n))
    drawn = usable.where(wanted)  # about `rows` rows
    text = F.col(text_col).cast("string").cast("binary")
    size = F.octet_length(text)
    spread = F.concat(*(text.substr((F.lit(i) * (size - CHUNK) / (TRAIN_SPANS - 1)).cast("int") + 1, F.lit(CHUNK)) for i in range(TRAIN_SPANS)))
    short = F.when(size > TRAIN_SPANS * CHUNK, spread).otherwise(text)
    found = docs.select(F.col(id_col).alias("id"), short.alias("text")).join(F.broadcast(drawn), "id").toPandas()
    found = found.sort_values(["id", "quality"], kind="stable")
    return [t or b"" for t in found["text"].map(lambda t: None if t is None else bytes(t))], found["quality"].to_numpy(dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Net:
    return train(*training_rows(docs, labels, rows, id_col, text_col))


def score(docs: DataFrame, net: Net, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {name}")
    plain, put, back = shelved(docs.columns)
    rows = docs.select(*put, col(text_col).cast("string").cast("binary").alias("_bytes"))
    names = [*plain, "_score"]
    parts = (net.table, net.bias, net.weight, net.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(*parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = own.scores([t or b"" for t in part.columns[-1].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64())], names=names)

    return rows.mapInArrow(run, extended(rows.drop("_bytes"), "_score double")).select(*back, F.col("_score").alias(name))


def keep_good(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold."""
    name = fresh(docs, "_score")
    return score(docs, net, text_col, name).where(F.col(name) >= threshold).select(cols(docs.columns))
