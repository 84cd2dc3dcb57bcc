"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole text, each filter is
max-pooled within its chunk, a small hidden layer turns a chunk into features, and their mean over all chunks gives
one probability. Training is on the driver, over at most max_rows labelled rows of either class, whole texts.

Results: one row per input row. A null or empty text is one chunk of padding and gets that chunk's score. Where
there is no labelled row of one of the classes, every score is the share of class 1 (0.5 without any label). Rows that
repeat an id are scored each by its own text. A null id is never held out nor learned from. No rows give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw_texts, small_batches

CHUNK, WIDTH, EMBED, FILTERS, HIDDEN = 256, 8, 6, 32, 16
#: Neighbouring chunks share WIDTH - 1 bytes, so that every filter sees every position of the text.
STEP = CHUNK - WIDTH + 1


def chunks_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts (rows of bytes, padded with 0) and the index of each chunk's text."""
    rows, of = [], []
    for k, text in enumerate(raw):
        n = max(1, -(-(len(text) - WIDTH + 1) // STEP))
        buf = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        buf[: len(text)] = np.frombuffer(text, np.uint8)
        rows.append(np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP])
        of.append(np.full(n, k))
    return np.concatenate(rows), np.concatenate(of)


@dataclass
class ByteConvNet:
    """p: the parameters by name; or only a constant, where there was nothing to learn from."""

    p: dict[str, np.ndarray]
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 7) -> ByteConvNet:
        g = np.random.default_rng(seed)
        f = lambda *shape, s: (g.standard_normal(shape) * s).astype(np.float32)
        return ByteConvNet({"emb": f(256, EMBED, s=0.5), "w": f(WIDTH * EMBED, FILTERS, s=(2 / (WIDTH * EMBED)) ** 0.5), "wb": f(FILTERS, s=0), "u": f(FILTERS, HIDDEN, s=FILTERS**-0.5), "ub": f(HIDDEN, s=0), "o": f(HIDDEN, s=HIDDEN**-0.5), "ob": f(1, s=0)})

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """The filters' maxima over each chunk; with where, also their positions."""
        best, at = [], []
        for low in range(0, len(chunks), 64):
            x = self.p["emb"][chunks[low : low + 64]]
            c = len(x)
            s = x.strides
            win = np.lib.stride_tricks.as_strided(x, (c, STEP, WIDTH * EMBED), (s[0], s[1], s[2]))
            y = (np.ascontiguousarray(win).reshape(c * STEP, -1) @ self.p["w"]).reshape(c, STEP, FILTERS)
            if where:
                k = y.argmax(1)
                at.append(k)
                best.append(np.take_along_axis(y, k[:, None], 1)[:, 0])
            else:
                best.append(y.max(1))
        h = np.concatenate(best) + self.p["wb"]
        return (h, np.concatenate(at)) if where else h

    def score(self, raw: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raw), self.constant)
        chunks, of = chunks_of(raw)
        z = np.tanh(np.maximum(self.pooled(chunks), 0) @ self.p["u"] + self.p["ub"])
        n = np.bincount(of, minlength=len(raw))
        mean = np.stack([np.bincount(of, z[:, k], len(raw)) for k in range(HIDDEN)], 1) / n[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.p["o"] + self.p["ob"], -30, 30)))

    def gradients(self, raw: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        chunks, of = chunks_of(raw)
        n = np.bincount(of, minlength=len(raw)).astype(np.float32)
        h, at = self.pooled(chunks, where=True)
        a = np.maximum(h, 0)
        z = np.tanh(a @ self.p["u"] + self.p["ub"])
        mean = np.zeros((len(raw), HIDDEN), np.float32)
        np.add.at(mean, of, z)
        mean /= n[:, None]
        d = (1 / (1 + np.exp(-np.clip(mean @ self.p["o"] + self.p["ob"], -30, 30))) - y).astype(np.float32) * weight / len(raw)
        dz = (d / n)[of][:, None] * self.p["o"] * (1 - z * z)
        dh = (dz @ self.p["u"].T) * (h > 0)
        bytes_at = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        win = self.p["emb"][bytes_at].reshape(len(chunks), FILTERS, -1)
        dwin = (dh[:, :, None] * self.p["w"].T).reshape(-1, EMBED)
        demb = np.stack([np.bincount(bytes_at.ravel(), dwin[:, e], 256) for e in range(EMBED)], 1)
        return {"emb": demb.astype(np.float32), "w": np.einsum("cf,cfk->kf", dh, win), "wb": dh.sum(0), "u": a.T @ dz, "ub": dz.sum(0), "o": mean.T @ d, "ob": d.sum(keepdims=True)}


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.006, seed: int = 7, least_steps: int = 400) -> ByteConvNet:
    """Adam over shuffled batches, with more epochs where there are few rows; both classes weigh the same in sum."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return ByteConvNet({}, float(labels.mean()) if len(labels) else 0.5)
    net, g = ByteConvNet.fresh(seed), np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in net.p.items()}
    two = {k: np.zeros_like(v) for k, v in net.p.items()}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    each = -(-len(texts) // batch)
    epochs = max(epochs, -(-least_steps // each))
    step, steps = 0, epochs * each
    for _ in range(epochs):
        order = g.permutation(len(texts))
        for low in range(0, len(order), batch):
            pick = order[low : low + batch]
            grad = net.gradients([texts[k] for k in pick], labels[pick], weight[pick])
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for k, v in net.p.items():
                one[k] += 0.1 * (grad[k] - one[k])
                two[k] += 0.01 * (grad[k] ** 2 - two[k])
                v -= pace * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(column, modulus: int, remainder: int):
    """crc32 of the id as text, modulo modulus, is remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use, max_rows: int) -> tuple[list[bytes], np.ndarray]:
    """At most max_rows labelled texts of either class, the same ones each time: those with the lowest hash of the id.

    Where rows repeat an id, its least text is the one; a label that repeats with both values is 1.
    """
    ranked = labels.where(use & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label).alias("y")).groupBy("label_id").agg(F.max("y").alias("y"))
    pick = [ranked.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows) for y in (0, 1)]
    # The labels are at most 2 * max_rows rows here, so they may be broadcast.
    found = docs.join(F.broadcast(pick[0].union(pick[1])), F.col("doc_id") == F.col("label_id"))
    got = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending")])
    return raw_texts(got.column("text").combine_chunks()) if got.num_rows else [], got.column("y").to_numpy()


def score_texts(docs: DataFrame, net, threshold: float, id_col: str = "doc_id", text_col: str = "text", slab: int = 256) -> DataFrame:
    """(doc_id, score, predicted) of every row, by an object with score(list of UTF-8 texts)."""

    def run(batch: pa.RecordBatch) -> dict:
        raw = raw_texts(batch.column(1))
        s = np.concatenate([net.score(raw[k : k + slab]) for k in range(0, len(raw), slab)])
        return {"doc_id": batch.column(0), "score": pa.array(s.astype(float)), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, max_rows: int = 1000, epochs: int = 8) -> ByteConvNet:
    """A network fitted on at most max_rows labelled rows of either class outside the held-out fold."""
    texts, y = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, label, ~held_out(F.col("doc_id"), modulus, remainder), max_rows)
    return fit(texts, y, epochs)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, modulus: int = 5, remainder: int = 0, max_rows: int = 1000, epochs: int = 8) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a network trained outside the held-out fold."""
    scored = score_texts(docs, train(docs, labels, label, modulus, remainder, max_rows, epochs), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, net: ByteConvNet, threshold: float = 0.3, text_col: str = "text", slab: int = 256) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns.

    Only the text goes to Python and only the decision comes back; the rows stay in the JVM.
    """

    def good(texts: pa.Array) -> pa.Array:
        keep = [net.score(raw_texts(texts.slice(k, slab))) >= threshold for k in range(0, len(texts), slab)]
        return pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))

    return small_batches(docs).where(F.arrow_udf(good, "boolean")(F.col(text_col).cast("string")))
