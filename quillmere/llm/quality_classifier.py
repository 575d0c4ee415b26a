"""Quality classifier: a convolutional network over bytes, in numpy.

Filters of TAPS bytes are tables of a weight for each tap and byte value, so the convolution is a sum of lookups.
Every start of a window counts for its block of BLOCK bytes; a chunk is two neighbouring blocks, so chunks overlap by
half and together cover the whole document. Each filter is max-pooled over a chunk; the mean, least and largest of
the pooled values over all chunks are combined by a logistic function. The filters are trained by Adam through the
places of the maxima, on chunks of a bounded sample of labelled rows; the last layer is then fitted on whole
documents of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm import common
from quillmere.llm.toxicity import training_rows

TAPS, FILTERS, BLOCK = 8, 16, 256
#: Bytes that are convolved at once, a multiple of BLOCK: bounds memory on very long texts.
SEGMENT = 64 * BLOCK
#: Rows that are learned from at most, and the longest text among them.
FIT_ROWS, FIT_CHARS = 2500, 200_000


def convolved(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Filter values at n starts; data holds TAPS - 1 bytes more."""
    out = np.take(tables[0], data[:n], axis=0, mode="clip")
    other = np.empty_like(out)
    for k in range(1, TAPS):
        np.take(tables[k], data[k : n + k], axis=0, out=other, mode="clip")
        out += other
    return out


def padded(text: bytes) -> tuple[np.ndarray, int]:
    """Bytes filled with zeros to whole blocks and the last window; the number of starts in the text, one at least."""
    n = max(1, len(text))
    data = np.zeros(-(-n // BLOCK) * BLOCK + TAPS - 1, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return data, n


def block_maxima(tables: np.ndarray, text: bytes) -> np.ndarray:
    data, n = padded(text)
    parts = []
    for start in range(0, len(data) - TAPS + 1, SEGMENT):
        size = min(SEGMENT, len(data) - TAPS + 1 - start)
        values = convolved(tables, data[start : start + size + TAPS - 1], size)
        if start + size > n:
            values[n - start :] = -np.inf
        parts.append(values.reshape(-1, BLOCK, FILTERS).max(axis=1))
    return np.concatenate(parts)


def document_features(tables: np.ndarray, text: bytes) -> np.ndarray:
    """Mean, least and largest over the chunks of each filter's maximum, squashed."""
    blocks = np.tanh(block_maxima(tables, text))
    chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
    return np.concatenate([chunks.mean(axis=0), chunks.min(axis=0), chunks.max(axis=0)])


@dataclass
class Network:
    tables: np.ndarray  # taps x 256 x filters
    weights: np.ndarray  # of document_features, standardised
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def score(self, text: str) -> float:
        f = (document_features(self.tables, text.encode("utf-8", "replace")) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(f @ self.weights + self.bias, -30, 30))))


def untrained() -> Network:
    """Half for every text: for tables without labels of both kinds."""
    n = 3 * FILTERS
    return Network(np.zeros((TAPS, 256, FILTERS), np.float32), np.zeros(n), 0.0, np.zeros(n), np.ones(n))


def train_filters(texts: list[bytes], y: np.ndarray, epochs: int, seed: int, batch: int = 64, chunks: int = 4, rate: float = 0.02) -> np.ndarray:
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.25, (TAPS, 256, FILTERS)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, FILTERS), 0.0
    moments = [np.zeros_like(tables), np.zeros_like(tables), np.zeros(FILTERS + 1), np.zeros(FILTERS + 1)]
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    width, step = 2 * BLOCK, 0
    data = [padded(t) for t in texts]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            windows, owner, ends = [], [], []
            for r, i in enumerate(rows):
                buffer, n = data[i]
                last = max(0, (len(buffer) - TAPS + 1) // BLOCK - 2)
                for start in rng.choice(last + 1, min(chunks, last + 1), replace=False) * BLOCK:
                    part = buffer[start : start + width + TAPS - 1]
                    windows.append(np.pad(part, (0, width + TAPS - 1 - len(part))))
                    owner.append(r)
                    ends.append(n - start)
            w, owner, ends = np.stack(windows), np.array(owner), np.array(ends)
            values = np.take(tables[0], w[:, :width], axis=0)
            for k in range(1, TAPS):
                values += np.take(tables[k], w[:, k : width + k], axis=0)
            values[np.arange(width) >= ends[:, None]] = -1e9
            at = values.argmax(axis=1)
            top = np.tanh(np.take_along_axis(values, at[:, None], axis=1)[:, 0])
            share = 1 / np.bincount(owner, minlength=len(rows))[owner]
            pooled = np.zeros((len(rows), FILTERS))
            np.add.at(pooled, owner, top * share[:, None])
            p = 1 / (1 + np.exp(-np.clip(pooled @ out + bias, -30, 30)))
            error = (p - y[rows]) * balance[rows] / len(rows)
            toward = (error[owner] * share)[:, None] * out * (1 - top**2)
            grads = np.zeros_like(tables)
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(TAPS):
                np.add.at(grads[k], (w[np.arange(len(w))[:, None], at + k], column), toward)
            last_grads = np.append(pooled.T @ error, error.sum()) + np.append(1e-4 * out, 0)
            step += 1
            for grad, m, v, target in ((grads, moments[0], moments[1], tables), (last_grads, moments[2], moments[3], None)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                if target is None:
                    out, bias = out - move[:-1], bias - move[-1]
                else:
                    target -= move.astype(np.float32)
    return tables


def fit_network(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, epochs: int = 6, seed: int = 7) -> Network:
    """Learned from rows that aren't held out; the same tables, rows and seed give the same network."""
    sample = training_rows(docs, labels, "quality", rows, chars)
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return untrained()
    texts = [t.encode("utf-8", "replace") for t, _ in sample]
    tables = train_filters(texts, y, max(epochs, -(-1500 // len(texts))), seed)
    x = np.stack([document_features(tables, t) for t in texts])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([*[1.0] * x.shape[1], 1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return Network(tables, beta[:-1], float(beta[-1]), centre, scale)


def score_quality(docs: DataFrame, network: Network, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs, from its whole text. A null or empty text is scored as one empty
    window; rows are scored one by one, long texts in segments; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            scores = [network.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
