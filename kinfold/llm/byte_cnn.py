"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
``OVERLAP`` and cover all of it.  In a chunk every byte is embedded, learned
filters of ``WIDTH`` bytes move over it ``STRIDE`` bytes at a time and each
filter's greatest response is kept; a small hidden layer follows.  Over a
document's chunks the hidden values are combined by mean and by maximum, and a
logistic unit makes one probability of both.

It is fitted on at most ``TRAIN_ROWS`` labelled rows, those of least hash, and on
at most ``TRAIN_CHUNKS`` chunks of each, evenly spread over the text: a documented
bound, the same at every size of the corpus; the executors cut the texts.  Scoring
covers every byte of every text, a group of chunks at a time; the fitted network
is a few kilobytes and is broadcast.

Cases: null and empty texts are one chunk of padding and get its score; labels
without a text, unlabelled texts and repeated rows are fine, each row is scored
alone; very long texts take memory for one group of chunks besides the text; with
fewer than two classes in the labels the score is their mean; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

CHUNK, OVERLAP = 1024, 64
WIDTH, STRIDE = 8, 4
DIM, FILTERS, HIDDEN = 8, 32, 16
TRAIN_ROWS, TRAIN_CHUNKS = 3000, 256
#: Chunks that pass through the network together.
GROUP = 128
EPOCHS, BATCH, RATE, DECAY = 10, 32, 3e-3, 1e-4
SEED = 7
_PAD = 256
_STEP = CHUNK // STRIDE


class Chunks:
    """The chunks of a block's documents, cut when they are asked for."""

    def __init__(self, at: np.ndarray, data: np.ndarray):
        self.at, self.data, self.size = at, data, np.diff(at)
        self.count = np.maximum(1, -(-(self.size - OVERLAP) // (CHUNK - OVERLAP)))
        self.first = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return int(self.count.sum())

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """(chunks, CHUNK) byte codes, padded."""
        of = np.searchsorted(self.first, numbers, "right") - 1
        place = ((numbers - self.first[of]) * (CHUNK - OVERLAP))[:, None] + np.arange(CHUNK)
        inside = place < self.size[of][:, None]
        out = np.full(place.shape, _PAD, np.int16)
        out[inside] = self.data[(place + self.at[of][:, None])[inside]]
        return out


def chunks(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a block and the number of chunks of each document."""
    cut = Chunks(at, data)
    return cut.codes(np.arange(len(cut))), cut.count


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = {
        "embed": normal(257, DIM, scale=0.5), "filters": normal(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5), "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "out_bias": np.zeros(1, np.float32),
    }
    net["embed"][_PAD] = 0
    return net


def _responses(net: dict, codes: np.ndarray) -> np.ndarray:
    """(chunks, places, FILTERS): a window of two strides is the sum over its halves."""
    x = net["embed"][codes].reshape(len(codes), _STEP, STRIDE * DIM)
    half = STRIDE * DIM
    out = x[:, :-1].reshape(-1, half) @ net["filters"][:half]
    out += x[:, 1:].reshape(-1, half) @ net["filters"][half:]
    return out.reshape(len(codes), _STEP - 1, FILTERS)


def _pooled(net: dict, codes: np.ndarray) -> np.ndarray:
    """Max-pooled filters and the filled share of every chunk."""
    best = _responses(net, codes).max(1) + net["filter_bias"]
    return np.concatenate([best, (codes != _PAD).mean(1, dtype=np.float32)[:, None]], 1)


def _combine(net: dict, pooled: np.ndarray, count: np.ndarray):
    hidden = np.maximum(pooled @ net["hidden"] + net["hidden_bias"], 0)
    first = np.cumsum(count) - count
    mean = np.add.reduceat(hidden, first) / count[:, None]
    top = np.maximum.reduceat(hidden, first)
    both = np.concatenate([mean, top], 1)
    return hidden, both, both @ net["out"] + net["out_bias"][0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(net: dict, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Probabilities of a block's documents; chunks pass through in bounded groups."""
    cut = Chunks(at, data)
    pooled = np.concatenate([_pooled(net, cut.codes(np.arange(i, min(i + GROUP, len(cut))))) for i in range(0, len(cut), GROUP)])
    return sigmoid(_combine(net, pooled, cut.count)[2].astype(np.float64))


def _gradients(net: dict, codes: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = len(codes)
    responses = _responses(net, codes)
    place = responses.argmax(1)
    best = np.take_along_axis(responses, place[:, None], 1)[:, 0] + net["filter_bias"]
    pooled = np.concatenate([best, (codes != _PAD).mean(1, dtype=np.float32)[:, None]], 1)
    hidden, both, z = _combine(net, pooled, count)
    of = np.repeat(np.arange(len(count)), count)
    dz = ((sigmoid(z) - y) / len(y)).astype(np.float32)
    dboth = dz[:, None] * net["out"]
    top = hidden == both[of, HIDDEN:]
    share = top / np.maximum(1, np.add.reduceat(top, np.cumsum(count) - count)[of])
    dhidden = dboth[of, :HIDDEN] / count[of][:, None] + dboth[of, HIDDEN:] * share
    dhidden *= hidden > 0
    dpooled = dhidden @ net["hidden"].T
    dbest = dpooled[:, :FILTERS]
    taps = (place[:, None, :] * STRIDE + np.arange(WIDTH)[None, :, None]).transpose(0, 2, 1)  # chunk, filter, tap
    seen = codes[np.arange(n)[:, None, None], taps]
    x = net["embed"][seen]  # chunk, filter, tap, DIM
    dfilters = np.einsum("nf,nftd->tdf", dbest, x).reshape(WIDTH * DIM, FILTERS)
    dx = dbest[:, :, None, None] * net["filters"].T.reshape(1, FILTERS, WIDTH, DIM)
    dembed = np.zeros_like(net["embed"])
    np.add.at(dembed, seen.reshape(-1), dx.reshape(-1, DIM))
    dembed[_PAD] = 0
    return {
        "embed": dembed, "filters": dfilters, "filter_bias": dbest.sum(0), "hidden": pooled.T @ dhidden, "hidden_bias": dhidden.sum(0),
        "out": both.T @ dz, "out_bias": dz.sum(keepdims=True),
    }


def sample_chunks(text: bytes, most: int = TRAIN_CHUNKS) -> np.ndarray:
    """A text's chunks, or as many as ``most`` of them at even distances."""
    cut = Chunks(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    n = len(cut)
    return cut.codes(np.arange(n) if n <= most else np.arange(most) * n // most)


def fit(texts: list[bytes | np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A network fitted with Adam on texts or their chunks."""
    rng = np.random.default_rng(seed)
    net = _start(rng)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        net["out"][:] = 0
        net["out_bias"][:] = np.log(rate / (1 - rate))
        return net
    net["out_bias"][:] = np.log(y.mean() / (1 - y.mean()))
    cut = [t if isinstance(t, np.ndarray) else sample_chunks(t) for t in texts]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            codes = np.concatenate([cut[r] for r in rows])
            grads = _gradients(net, codes, np.array([len(cut[r]) for r in rows]), y[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= (rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + RATE * DECAY * net[k])).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(batches, most):
    for batch in batches:
        cut = [sample_chunks(t.as_py(), most).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("quality"), pa.array(cut, pa.binary())], names=["h", "quality", "chunks"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_chunks: int = TRAIN_CHUNKS) -> dict[str, np.ndarray]:
    """Fit on the bounded sample; only rows that are not held out are read for it."""
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = ids.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text")
    cut = texts.mapInArrow(lambda batches: _sampled(batches, most_chunks), "h bigint, quality int, chunks binary")
    sample = cut.orderBy("h", "chunks").limit(rows).collect()  # at most `rows` of at most `most_chunks` chunks
    return fit([np.frombuffer(r["chunks"], np.int16).reshape(-1, CHUNK) for r in sample], [r["quality"] for r in sample])


def _score(batches, net):
    net = net.value
    for batch in batches:
        out = [score(net, at, data) for _, _, at, data in W.blocks(batch.column("text"))]
        out = np.round(np.concatenate(out), 6) if out else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lambda batches: _score(batches, net), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
