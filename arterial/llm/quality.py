"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a fixed code (its character class and a random vector). Learned
filters look at eight bytes at every fourth byte of the whole text; a chunk is
256 bytes and overlaps the next by half, and keeps the largest and the mean
response of each filter. A hidden layer reads each chunk; the largest response
of each hidden unit over all chunks gives one probability. A text is read
piece by piece, so memory does not grow with its length.

Null text counts as empty; an empty text has one blank chunk and a score like
any other. Rows without a label, or with a null doc_id, teach nothing; if
labels of only one value are there, or none, every score is that value or 0.5.
Repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import slices

#: Bound of the labelled rows of each class that the network learns from, and of their length.
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 100_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3

CODE, STRIDE, FILTERS, HIDDEN = 8, 4, 32, 16
ROWS = 32  # of filter places in half a chunk
HALF = ROWS * STRIDE
#: Filter places worked on at a time.
SEGMENT = 2048 * ROWS
#: Passes over the sample, and the least number of steps where it is small.
EPOCHS, STEPS, BATCH, RATE = 5, 450, 32, 4e-3


def _codes() -> np.ndarray:
    rng = np.random.default_rng(11)
    b = np.arange(256)
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    mark = (b > 32) & (b < 127) & ~upper & ~lower & ~((b >= 48) & (b <= 57))
    out = np.concatenate([np.stack([upper, mark, b == 32, b >= 128], 1), rng.normal(0, 0.5, (256, CODE - 4))], 1)
    out[0] = 0
    return out.astype(np.float32)


CODES = _codes()


@dataclass
class Network:
    a: np.ndarray  # filters' first four bytes
    b: np.ndarray  # filters' last four bytes
    c: np.ndarray
    w: np.ndarray  # hidden layer over the largest and the mean responses
    d: np.ndarray
    v: np.ndarray
    e: np.ndarray

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng, k = np.random.default_rng(seed), CODE * STRIDE
        new = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return Network(new(k, FILTERS, s=0.2), new(k, FILTERS, s=0.2), zero(FILTERS), new(2 * FILTERS, HIDDEN, s=0.2), zero(HIDDEN) + 0.1, new(HIDDEN, s=0.3), zero(1))


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, every text filled up with zeros to whole half-chunks and at
    least one blank filter place; halves and filter places of each text."""
    halves = np.array([(len(t) + STRIDE) // HALF + ((len(t) + STRIDE) % HALF > 0) for t in texts], np.int64)
    places = np.array([-(-len(t) // STRIDE) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves)), np.uint8), halves, places


def _filled(halves: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Filter places with text in each half-chunk."""
    first = np.cumsum(halves) - halves
    index = np.arange(halves.sum()) - np.repeat(first, halves)
    return np.clip(np.repeat(places, halves) - index * ROWS, 0, ROWS)


def _responses(net: Network, raw: np.ndarray, filled: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and filter responses in half-chunks begin to end."""
    piece = raw[begin * HALF : end * HALF + STRIDE]
    x = CODES[piece].reshape(-1, CODE * STRIDE)
    n = (end - begin) * ROWS
    if len(x) == n:
        x = np.concatenate([x, np.zeros((1, CODE * STRIDE), np.float32)])
    act = x[:n] @ net.a
    act += x[1:] @ net.b
    act += net.c
    np.maximum(act, 0, out=act)
    act = act.reshape(-1, ROWS, FILTERS)
    short = np.flatnonzero(filled[begin:end] < ROWS)
    for h in short:
        act[h, filled[begin + h] :] = 0
    return x, act


def _pooled(halves: np.ndarray, most: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks from half-chunks: features, the left and right half of each chunk
    and the first chunk of each text."""
    ends = np.cumsum(halves)
    left = np.ones(int(ends[-1]), bool)
    left[ends - 1] = halves == 1  # a text's last half begins no chunk, unless it is alone
    left = np.flatnonzero(left)
    alone = np.repeat(halves == 1, np.maximum(halves - 1, 1))
    right = np.where(alone, left, left + 1)
    features = np.concatenate([np.maximum(most[left], most[right]), (mean[left] + mean[right]) / 2], 1)
    per = np.maximum(halves - 1, 1)
    return features, left, right, np.cumsum(per) - per


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    raw, halves, places = _padded(texts)
    filled = _filled(halves, places)
    most, mean = [], []
    step = SEGMENT // ROWS
    for at in range(0, len(filled), step):
        to = min(at + step, len(filled))
        _, act = _responses(net, raw, filled, at, to)
        most.append(act.max(axis=1))
        mean.append(act.sum(axis=1) / np.maximum(filled[at:to, None], 1))
    features, _, _, first = _pooled(halves, np.concatenate(most), np.concatenate(mean))
    hidden = np.maximum(features @ net.w + net.d, 0)
    score = np.maximum.reduceat(hidden, first, axis=0) @ net.v + net.e
    return 1 / (1 + np.exp(-np.clip(score.astype(np.float64), -30, 30)))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    raw, halves, places = _padded(texts)
    filled = _filled(halves, places)
    x, act = _responses(net, raw, filled, 0, len(filled))
    at = act.argmax(axis=1)
    most = np.take_along_axis(act, at[:, None], 1)[:, 0]
    share = 1 / np.maximum(filled, 1).astype(np.float32)
    mean = act.sum(axis=1) * share[:, None]
    features, left, right, first = _pooled(halves, most, mean)
    hidden = np.maximum(features @ net.w + net.d, 0)
    doc = np.maximum.reduceat(hidden, first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(doc @ net.v + net.e, -30, 30)))
    ds = ((p - labels) / len(texts)).astype(np.float32)
    out = {"v": doc.T @ ds, "e": ds.sum(keepdims=True)}
    dh = np.zeros_like(hidden)
    for i, (b, e) in enumerate(zip(first, [*first[1:], len(hidden)])):
        top = b + hidden[b:e].argmax(axis=0)
        dh[top, np.arange(HIDDEN)] = ds[i] * net.v * (doc[i] > 0)
    out |= {"w": features.T @ dh, "d": dh.sum(0)}
    df = dh @ net.w.T
    dmost, dmean = np.zeros_like(most), np.zeros_like(mean)
    wins = most[left] >= most[right]
    np.add.at(dmost, left, df[:, :FILTERS] * wins)
    np.add.at(dmost, right, df[:, :FILTERS] * ~wins)
    np.add.at(dmean, left, df[:, FILTERS:] / 2)
    np.add.at(dmean, right, df[:, FILTERS:] / 2)
    dact = np.repeat((dmean * share[:, None])[:, None], ROWS, 1)
    h, f = np.ogrid[: len(at), :FILTERS]
    dact[h, at, f] += dmost
    dact *= act > 0
    dact = dact.reshape(-1, FILTERS)
    return out | {"a": x[:-1].T @ dact, "b": x[1:].T @ dact, "c": dact.sum(0)}


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network learned from texts and labels 0 or 1, by Adam."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.v[:] = 0
        net.e[:] = 0 if not len(y) else 30 if y[0] else -30
        return net
    m = {k: np.zeros_like(p) for k, p in vars(net).items()}
    s = {k: np.zeros_like(p) for k, p in vars(net).items()}
    batches = -(-len(raw) // BATCH)
    epochs = max(epochs, -(-STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in _gradients(net, [raw[i] for i in some], y[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                getattr(net, k).__isub__((rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Learn from at most ``per_class`` documents of each label, those with the
    smallest hash of doc_id, of texts of at most SAMPLE_CHARS characters. Of
    rows that repeat a doc_id, the first text in order teaches; null is empty."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select("doc_id", F.col(column).alias("label")).dropDuplicates(["doc_id"])
    few = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = few[0].unionByName(few[1])
    # at most 2 * per_class ids are broadcast, and as many texts come back
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    one = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = sorted((r.doc_id, r.text, r.label) for r in one.collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            p = probabilities(net, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all columns."""
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            p = probabilities(net, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(judge, docs.schema)
