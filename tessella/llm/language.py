"""Language identification: a byte convolutional network, trained and applied in numpy.

Texts are cut into fixed windows of bytes over their whole length. Bytes are embedded, filters of
several widths run over the embedding, each is max-pooled over the window, and a softmax layer gives
language probabilities; a text's score is the mean over its windows, weighted by their bytes.

It learns on the driver from a bounded, documented sample of labelled rows (``train_rows``), and the
network (a few KB) is broadcast. Only the text enters a prediction.

Defined cases: null texts and texts without a letter are ``und`` with score 1; empty texts are without a
letter; repeated rows get equal rows; without any labelled row every text is ``und`` with score 0;
further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out, learnable, map_arrow
from tessella.llm.words import utf8

WINDOW = 256
BATCH_WINDOWS = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Labelled rows learned from, and windows of each.
TRAIN_ROWS = 2500
TRAIN_WINDOWS = 2
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # max width * EMBED x filters of all widths; shorter filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Im2col matrix and filter responses of windows of bytes."""
        n, length = windows.shape
        x = self.embed[windows].reshape(n, length * EMBED)
        widest = max(WIDTHS)
        steps = length - widest + 1
        view = np.lib.stride_tricks.as_strided(x, (n, steps, widest * EMBED), (x.strides[0], EMBED * x.itemsize, x.itemsize))
        columns = view.reshape(n * steps, widest * EMBED)
        return columns, (columns @ self.filters).reshape(n, steps, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.hidden(windows)[1].max(axis=1) + self.bias, 0)
        return softmax(pooled @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def taps() -> np.ndarray:
    """1 where a filter has a weight."""
    mask = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def cut_windows(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text as windows; the last is filled up with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 11) -> Network:
    """Adam on the cross-entropy of windows; the gradient of max-pooling goes to the largest response."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        windows = cut_windows(np.frombuffer(text, np.uint8))
        for k in rng.choice(len(windows), min(len(windows), TRAIN_WINDOWS), replace=False):
            xs.append(windows[k])
            ys.append(langs.index(label))
    x, y = np.stack(xs), np.array(ys)
    mask = taps()
    total = FILTERS * len(WIDTHS)
    net = Network(
        langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    weight = (len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))).astype(np.float32) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            n = len(pick)
            columns, response = net.hidden(x[pick])
            steps = response.shape[1]
            where = response.argmax(axis=1)
            top = np.take_along_axis(response, where[:, None, :], 1)[:, 0, :] + net.bias
            pooled = np.maximum(top, 0)
            p = softmax(pooled @ net.out + net.out_bias)
            p[np.arange(n), y[pick]] -= 1
            p *= (weight[y[pick]] / n)[:, None]
            back = (p @ net.out.T) * (top > 0)
            grads = {"out": pooled.T @ p, "out_bias": p.sum(0), "bias": back.sum(0)}
            rows = (np.arange(n)[:, None] * steps + where).ravel()  # of the im2col matrix
            cells = columns[rows].reshape(n, total, -1)
            grads["filters"] = np.einsum("nfk,nf->kf", cells, back) * mask
            to_cells = back[:, :, None] * net.filters.T[None]  # n x filters x taps
            shown = x[pick][np.arange(n)[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))]
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], shown.ravel(), to_cells.reshape(-1, EMBED))
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                change = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """At most ``rows`` labelled rows of the learnable part, by the order of a hash of the id."""
    known = docs.where(learnable(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    known = known.select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    # ids first, so that no task sends more than ids; then the texts of those alone
    ids = known.select(F.xxhash64(F.lit("lang"), F.col("i")).alias("h"), "i").distinct().orderBy("h", "i").limit(rows)
    got = known.join(F.broadcast(ids), "i").collect()
    got.sort(key=lambda r: (r.h, r.t, r.l))
    return [bytes(r.t) for r in got], [r.l for r in got]


class Predictor:
    """Scores batches of texts: windows of many texts go through the network together."""

    def __init__(self, net: Network | None):
        self.net = net

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the best language and its mean probability."""
        lengths = np.diff(bounds)
        per_row = np.maximum(1, -(-lengths // WINDOW))
        start = np.concatenate([[0], np.cumsum(per_row)])
        total = np.zeros((len(lengths), len(self.net.langs)))
        row = np.repeat(np.arange(len(lengths)), per_row)
        at = bounds[row] + (np.arange(start[-1]) - start[row]) * WINDOW
        size = np.minimum(WINDOW, bounds[row + 1] - at)
        data = np.concatenate([data[: bounds[-1]], np.zeros(WINDOW, np.uint8)])
        for k in range(0, len(row), BATCH_WINDOWS):
            part = slice(k, k + BATCH_WINDOWS)
            windows = data[at[part, None] + np.arange(WINDOW)]
            windows[np.arange(WINDOW) >= size[part, None]] = 0
            np.add.at(total, row[part], self.net.probabilities(windows) * np.maximum(size[part], 1)[:, None])
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return best, total[np.arange(len(best)), best]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a network learned from the rows that may be learned from."""
    texts, labels = sample(docs, train_rows, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, labels) if texts else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            letters = np.array([x.is_valid and LETTER.search(x.as_py()) is not None for x in batch.column(2)], bool)
            names, score = np.full(batch.num_rows, "und", object), letters.astype(float) * 0 + 1
            if predictor.net is None:
                score[letters] = 0
            elif letters.any():
                data, bounds = utf8(batch.column(2).filter(pa.array(letters)))
                best, p = predictor.texts(data[bounds[0] :], bounds - bounds[0])
                names[letters], score[letters] = np.array(predictor.net.langs, object)[best], p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
