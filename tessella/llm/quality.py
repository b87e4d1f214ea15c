"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages, ``PASSAGE`` bytes each, over its whole length. Each passage is encoded
from what it consists of: classes of bytes and pairs of classes, lengths of words, words that repeat the
one before or any in the passage. A hidden layer embeds the encoding; gated attention weights
(Ilse et al. 2018) are learned from document labels alone, and the weighted representation is scored.

It learns on the driver from a bounded, documented sample of labelled rows (``train_rows``); the model
(some 20 KB) is broadcast. Only the text enters a score.

Defined cases: null and empty texts are one empty passage and get its score; repeated rows get equal
scores; rows whose ids repeat in the labels count once for each label row; without any label every score
is 0.5; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out, learnable, map_arrow
from tessella.llm.words import Hasher, chunks, space_table, utf8

PASSAGE = 512
HIDDEN = 16
ATTENTION = 8
TRAIN_ROWS = 4000
#: Passages of a training document that are drawn, evenly over its length.
TRAIN_PASSAGES = 12
CLASSES = 12


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line end, 6 bytes from 0x80, 7 full stop or comma, 8 ! or ?, 9 * # % $ &, 10 | or brackets or slashes, 11 quotes and dashes."""
    c = np.zeros(256, np.int64)
    c[0x61:0x7B], c[0x41:0x5B], c[0x30:0x3A], c[0x80:] = 1, 2, 3, 6
    for k, chars in ((4, b" \t"), (5, b"\n\r\x0b\x0c"), (7, b".,;:"), (8, b"!?"), (9, b"*#%$&@~^"), (10, b"|[]{}()<>/\\=_+"), (11, b"'\"-`")):
        c[list(chars)] = k
    return c


N_FEATURES = CLASSES + CLASSES * CLASSES + 6


class Encoder:
    """Feature rows of all passages of a batch of texts."""

    def __init__(self):
        self.hasher = Hasher(space_table(), False)
        self.classes = byte_classes()

    def passages(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of passages of each row)."""
        lengths = np.diff(bounds)
        per_row = np.maximum(1, -(-lengths // PASSAGE))
        first = np.concatenate([[0], np.cumsum(per_row)])
        n = int(first[-1])
        out = np.zeros((n, N_FEATURES), np.float32)
        if not len(data):
            return out, per_row
        row = np.repeat(np.arange(len(lengths)), lengths)
        owner = first[row] + (np.arange(len(data)) - bounds[row]) // PASSAGE
        kind = self.classes[data]
        size = np.maximum(1, np.bincount(owner, minlength=n)).astype(np.float32)[:, None]
        out[:, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair = (owner[inside] * CLASSES + kind[inside]) * CLASSES + kind[inside + 1]
        # shares of pairs are rare or common by orders of magnitude: their roots
        out[:, CLASSES : CLASSES + CLASSES**2] = np.sqrt(np.bincount(pair, minlength=n * CLASSES**2).reshape(n, -1) / size)
        starts, ends, _ = self.hasher.bounds(data, bounds)
        if len(starts):
            _, words, _ = self.hasher.numbers(data, bounds)
            mine = owner[starts]
            count = np.maximum(1, np.bincount(mine, minlength=n)).astype(np.float32)
            length = (ends - starts).astype(np.float32)
            again = (words[1:] == words[:-1]) & (mine[1:] == mine[:-1])
            order = np.lexsort((words, mine))
            w, m = words[order], mine[order]
            known = (w[1:] == w[:-1]) & (m[1:] == m[:-1])
            rest = out[:, CLASSES + CLASSES**2 :]
            rest[:, 0] = np.bincount(mine[1:][again], minlength=n) / count
            rest[:, 1] = np.bincount(m[1:][known], minlength=n) / count
            rest[:, 2] = np.bincount(mine, length, minlength=n) / count / 10
            rest[:, 3] = np.bincount(mine, np.minimum(length, 40) ** 2, minlength=n) / count / 100
            rest[:, 4] = count / size[:, 0] * 5
            rest[:, 5] = np.log1p(size[:, 0]) / 8
        return out, per_row


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, per_row: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags whose passages follow one another in ``x``; with what the gradient needs."""
        p, start = self.p, np.concatenate([[0], np.cumsum(per_row)[:-1]])
        bag = np.repeat(np.arange(len(per_row)), per_row)
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        e = np.exp(a - np.maximum.reduceat(a, start)[bag])
        e /= np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(e[:, None] * h, start)
        logit = np.clip(z @ p["c"] + p["d"], -30, 30)
        return {"x": x, "h": h, "t": t, "g": g, "e": e, "z": z, "bag": bag, "start": start, "y": 1 / (1 + np.exp(-logit))}


def train(texts: list[bytes], labels: list[int], epochs: int = 12, seed: int = 5) -> Model:
    """Adam on the cross-entropy of documents, classes weighed evenly up to a power of a half."""
    encoder, rng = Encoder(), np.random.default_rng(seed)
    bags = []
    for text in texts:
        x, _ = encoder.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        bags.append(x[np.unique(np.linspace(0, len(x) - 1, min(len(x), TRAIN_PASSAGES)).astype(int))])
    y = np.array(labels, float)
    everything = np.concatenate(bags)
    model = Model(everything.mean(0), 1 / (everything.std(0) + 0.05))
    model.p = {
        "W": rng.normal(0, 0.1, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    part = np.array([np.mean(y == 0), np.mean(y == 1)])
    weight = (0.5 / np.maximum(part, 1e-3)) ** 0.5
    first, second, step = dict.fromkeys(model.p, 0.0), dict.fromkeys(model.p, 0.0), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            per_row = np.array([len(bags[i]) for i in pick])
            f, p = model.forward(np.concatenate([bags[i] for i in pick]), per_row), model.p
            bag, start, h, e = f["bag"], f["start"], f["h"], f["e"]
            out = (f["y"] - y[pick]) * weight[y[pick].astype(int)] / len(pick)
            dz = out[:, None] * p["c"]
            dh = e[:, None] * dz[bag]
            de = (h * dz[bag]).sum(1)
            da = e * (de - np.add.reduceat(e * de, start)[bag])
            dtg = da[:, None] * p["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grads = {"c": f["z"].T @ out, "d": np.array([out.sum()]), "w": (f["t"] * f["g"]).T @ da, "V": h.T @ dt, "U": h.T @ dg, "W": f["x"].T @ dh + 1e-4 * p["W"], "b": dh.sum(0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                p[k] = p[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from at most ``train_rows`` labelled rows of the learnable part, by the order of a hash of the id; half of them at most of one label where there are enough of both."""
    known = labels.where(learnable(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"), F.xxhash64(F.lit("quality"), F.col(id_col)).alias("__h"))
    halves = [known.where(F.col("__y") == v).orderBy("__h", "__id").limit(train_rows // 2) for v in (0, 1)]
    picked = F.broadcast(halves[0].unionByName(halves[1]))  # bounded by train_rows
    got = docs.select(F.col(id_col).cast("long").alias("__id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t")).join(picked, "__id").select("t", "__y", "__h").collect()
    got.sort(key=lambda r: (r["__h"], r.t, r["__y"]))
    return train([bytes(r.t) for r in got], [r["__y"] for r in got]) if got else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; with ``keep``, the columns of ``docs`` for rows predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> np.ndarray:
        encoder, model = Encoder(), shared.value
        data, bounds = utf8(column)
        out = np.full(len(column), 0.5)
        if model is not None:
            for i, j in chunks(bounds):
                x, per_row = encoder.passages(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                out[i:j] = model.forward(x, per_row)["y"]
        return out

    if keep:
        place = docs.columns.index(text_col)

        def run_keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(scores(batch.column(place)) >= 0.5))

        return map_arrow(docs, run_keep, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
