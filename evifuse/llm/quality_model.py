"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over every byte of a text (``STRIDE`` 1). Their responses are max-pooled within overlapping chunks
that cover the whole text; the chunks' vectors are combined by mean and maximum, and a small dense
layer turns them into one probability. Fitting runs on a bounded sample of labelled rows,
scoring on every whole text inside tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.llm.shingles import utf8_buffers

WIDTH = 8  # bytes of a filter
STRIDE = 1
FILTERS = 24
HIDDEN = 16
BLOCK = 128  # bytes; two neighbouring blocks are a chunk, so chunks overlap by half
STEPS = BLOCK // STRIDE
# Bounds of the fitting sample: labelled rows of each class, and blocks taken of each text, evenly spaced.
SAMPLE_ROWS = 2_500
SAMPLE_BLOCKS = 64
EPOCHS = 16
EXCERPTS = 0.25  # share of the rows of an epoch that are shown as excerpts
BATCH = 48
RATE = 3e-3
DECAY = 1e-4
# Bytes scored at a time.
SCORE_BYTES = 1 << 18


@dataclass
class Network:
    """Weights: ``table[w, byte]`` are the filters' weights for a byte at place w (byte 0 is padding)."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    parts: list[str] = field(default_factory=lambda: ["table", "bias", "dense", "dense_bias", "out", "out_bias"])

    @staticmethod
    def start(seed: int) -> Network:
        r = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        table = normal(WIDTH, 256, FILTERS, scale=0.3)
        table[:, 0] = 0
        return Network(table, np.zeros(FILTERS, np.float32), normal(2 * FILTERS + 2, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=0.3), np.zeros(1, np.float32))


def blocks_of(raw: np.ndarray) -> np.ndarray:
    """Bytes of a text in whole blocks, padded with 0; a zero byte in it counts as 1. An empty text is one block. There is
    padding for a filter at the last byte, so that no filter reads into the next text."""
    out = np.zeros(-(-(max(len(raw), 1) + WIDTH - 1) // BLOCK) * BLOCK, np.uint8)
    out[:len(raw)] = np.maximum(raw, 1)
    return out


def convolve(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter responses (blocks, steps, filters) over the bytes of whole texts laid end to end."""
    ahead = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    n = len(data) // STRIDE
    z = np.tile(net.bias, (n, 1))
    for w in range(WIDTH):
        z += net.table[w][ahead[w:w + len(data):STRIDE]]
    z[data[::STRIDE] == 0] = -1e9  # starts in the padding
    return z.reshape(-1, STEPS, FILTERS)


def combine(top: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the mean and the maximum of its chunks, and how far it fills a chunk, without which a short
    text looks like a monotonous one; also the chunks and which neighbour each took."""
    nxt = np.append(np.arange(1, len(top)), len(top) - 1)
    ends = np.append(starts[1:], len(top)) - 1
    nxt[ends] = ends
    second = top[nxt] > top
    chunk = np.maximum(top, top[nxt])
    size = np.diff(np.append(starts, len(top)))
    mean = np.add.reduceat(chunk, starts) / size[:, None]
    fill = np.stack([np.minimum(lengths / (2 * BLOCK), 1), np.log1p(lengths) / 8], axis=1).astype(np.float32)
    return np.concatenate([mean, np.maximum.reduceat(chunk, starts), fill], axis=1), chunk, second


def probability(net: Network, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(doc @ net.dense + net.dense_bias)
    x = hidden @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), hidden


def scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of whole texts given as bytes; long ones are folded piece by piece."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SCORE_BYTES):
            size += len(texts[end])
            end += 1
        padded = [blocks_of(t) for t in texts[at:end]]
        data = np.concatenate(padded)
        # A filter reads at most WIDTH bytes past its start, so pieces overlap by that many.
        top = np.concatenate([
            np.maximum(convolve(net, data[k:k + SCORE_BYTES + BLOCK]).max(axis=1), 0)[:SCORE_BYTES // BLOCK] for k in range(0, len(data), SCORE_BYTES)
        ])
        starts = np.cumsum([0, *[len(p) // BLOCK for p in padded[:-1]]])
        out[at:end] = probability(net, combine(top, starts, np.array([len(t) for t in texts[at:end]]))[0])[0]
        at = end
    return out


def _gradients(net: Network, padded: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    data = np.concatenate(padded)
    starts = np.cumsum([0, *[len(p) // BLOCK for p in padded[:-1]]])
    z = convolve(net, data)
    step = z.argmax(axis=1)
    top = np.maximum(np.take_along_axis(z, step[:, None, :], 1)[:, 0], 0)
    doc, chunk, second = combine(top, starts, np.array([np.count_nonzero(p) for p in padded]))
    p, hidden = probability(net, doc)
    size = np.diff(np.append(starts, len(top)))
    dx = ((p - y) / len(y)).astype(np.float32)
    g = {"out": hidden.T @ dx, "out_bias": dx.sum(keepdims=True)}
    dh = dx[:, None] * net.out * (1 - hidden**2)
    g |= {"dense": doc.T @ dh, "dense_bias": dh.sum(axis=0)}
    dd = dh @ net.dense.T
    owner = np.repeat(np.arange(len(size)), size)
    dc = (dd[:, :FILTERS] / size[:, None])[owner]
    peak = chunk == doc[:, FILTERS:2 * FILTERS][owner]
    ties = np.add.reduceat(peak, starts, dtype=np.float32)
    dc = dc + peak * (dd[:, FILTERS:2 * FILTERS] / ties)[owner]
    dtop = np.where(second, 0, dc)
    moved = np.where(second, dc, 0)
    dtop[1:] += moved[:-1]
    dtop = np.where(top > 0, dtop, 0).astype(np.float32)
    g["bias"] = dtop.sum(axis=0)
    ahead = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    place = (np.arange(len(top)) * BLOCK)[:, None] + step * STRIDE
    f = np.broadcast_to(np.arange(FILTERS), place.shape)
    table = np.zeros((WIDTH, 256 * FILTERS))
    for w in range(WIDTH):
        table[w] = np.bincount((ahead[place + w].astype(np.int64) * FILTERS + f).ravel(), dtop.ravel(), 256 * FILTERS)
    g["table"] = table.reshape(net.table.shape).astype(np.float32)
    g["table"][:, 0] = 0
    return g


def excerpt(text: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A short piece of a text as a text of its own, so that short ones are learned as well."""
    n = int(np.count_nonzero(text))
    size = min(n, int(r.integers(24, 2 * BLOCK)))
    at = int(r.integers(0, n - size + 1))
    return blocks_of(text[at:at + size])


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network fitted with Adam on texts given as bytes in whole blocks; the same for the same rows."""
    net = Network.start(seed)
    r = np.random.Generator(np.random.PCG64(seed + 1))
    m = {k: np.zeros_like(getattr(net, k)) for k in net.parts}
    v = {k: np.zeros_like(getattr(net, k)) for k in net.parts}
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    draw = weight / weight.sum()
    t = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 2e-4
        order = r.choice(len(texts), len(texts), p=draw)
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            t += 1
            rows = [excerpt(texts[i], r) if r.random() < EXCERPTS else texts[i] for i in part]
            for k, g in _gradients(net, rows, labels[part].astype(np.float32)).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w = getattr(net, k)
                w -= rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + DECAY * w)
    return net


def fold(doc_id: Column, folds: int = 3) -> Column:
    """Fold of a document: CRC-32 of its id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fitting_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int, blocks: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks and labels of at most ``rows`` documents of each class, chosen by a hash of the id."""
    known = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).cast("int").alias("_y"))
    known = known.where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8_buffers(b.column("_text"))
            cuts = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                x = blocks_of(raw[lo:hi]).reshape(-1, BLOCK)
                if len(x) > blocks:
                    x = x[np.linspace(0, len(x) - 1, blocks).astype(int)]
                cuts.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(cuts, pa.binary())], names=["_id", "_y", "x"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # ``chosen`` has at most 2 * rows rows, whatever the size of the input.
    found = texts.join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    schema = T.StructType([found.schema["_id"], T.StructField("_y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    got = found.mapInArrow(thin, schema).orderBy(F.xxhash64("_id"), "_id", "x").limit(2 * rows)
    got = list(got.toLocalIterator())
    return [np.frombuffer(r["x"], np.uint8) for r in got], np.array([r["_y"] for r in got])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS,
) -> DataFrame:
    """One row per document: the id, ``held_out``, ``score``, ``predicted``.

    ``labels`` has an id and a label 0 or 1 as its first two columns; others, nulls and the fold that is held out
    are not learned from, the smaller of two labels counts. At most ``sample_rows`` rows of each class are fitted, and
    ``sample_blocks`` evenly spaced blocks of each. Only the bytes of a text enter its score. Where a class has no row to
    learn from, every score is the smoothed share of label 1 among those there are.

    A null text is scored as an empty one, a null id is not held out, repeated rows give a row each, other
    columns are ignored, an empty table gives no rows. Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    learn = labels.where(F.coalesce(fold(F.col(labels.columns[0])), F.lit(1)) != 1)
    x, y = fitting_sample(docs, learn, id_col, text_col, sample_rows, sample_blocks)
    model = fit(x, y) if 0 < y.sum() < len(y) else (int(y.sum()) + 1) / (len(y) + 2)
    sent = spark.sparkContext.broadcast(model)
    d = docs.select(
        F.col(id_col), F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            raw, at = utf8_buffers(b.column(2))
            if isinstance(net, Network):
                s = scores(net, [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)])
            else:
                s = np.full(b.num_rows, net)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return d.mapInArrow(run, T.StructType([
        T.StructField(id_col, d.schema[0].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ]))
