"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are binned at quantiles of the training sample. Boosting goes round the features in cycles: each turn fits a
tree of two splits over one feature's bins to the log-loss gradients and adds a small step of it to that feature's lookup
table, so every feature learns its shape beside the others. Then the pairs whose four-quadrant cuts explain most of what is
left get two-way tables by the same cyclic boosting. A score is the sigmoid of an intercept plus one addition per table, by
bin numbers, for whole slices of rows.

Features come from the whole text, in numpy over slices of texts: shares of byte classes, word lengths, repeated words and
repeated lines. Training reads at most about `max_rows` labelled documents (documented bound, by a hash of doc_id); their
features, not their texts, go to the driver.

Defined cases: null texts count as empty and are scored; rows with a null label or without a document teach nothing;
a document with several labels teaches each; without labels, or with one kind only, the score is the label mean (0.5
without any); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import map_arrow, own_name, slices, utf8
from skeinwork.llm.language_id import holds_out
from skeinwork.llm.segments import hashes, runs

MAX_ROWS, BINS, ROUNDS, RATE, PAIRS, THRESHOLD = 20_000, 48, 150, 0.1, 6, 0.3


def _class(*spans) -> np.ndarray:
    mask = np.zeros(256, bool)
    for x in spans:
        mask[x] = True
    return mask


_SPACE = _class(slice(9, 14), 32)
BYTE_CLASSES = {
    "upper": _class(slice(65, 91)),
    "lower": _class(slice(97, 123)),
    "other_letter": _class(slice(128, 256)),
    "digit": _class(slice(48, 58)),
    "stop_mark": _class(*map(ord, ".,;:?")),
    "shout": _class(ord("!")),
    "bar": _class(ord("|")),
    "symbol": _class(*map(ord, "#$%&*+=<>@^_~\\/{}[]`")),
    "line_end": _class(10),
}
FEATURES = ["log_bytes", *BYTE_CLASSES, "word_bytes", "short_words", "long_words", "distinct_words", "top_word", "twin_words", "repeated_lines", "line_bytes"]


def _repeats(of: np.ndarray, hash_: np.ndarray, n: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: distinct pieces, the count of the commonest, the weight of pieces seen before in the text."""
    order = np.lexsort((hash_, of))
    o, h, w = of[order], hash_[order], weight[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(at, append=len(o))
    top = np.zeros(n)
    np.maximum.at(top, o[at], sizes)
    return np.bincount(o[at], minlength=n), top, np.bincount(o[~new], w[~new], minlength=n)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row per text, a column per feature."""
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    of = np.repeat(np.arange(n), np.diff(offs))
    per = lambda mask: np.bincount(of[mask], minlength=n)
    safe = np.maximum(size, 1)
    cols = [np.log1p(size)] + [per(m[data]) / safe for m in BYTE_CLASSES.values()]
    s, e, at = runs(~_SPACE[data], offs)
    words, length, text = np.diff(at), e - s, np.repeat(np.arange(n), np.diff(at))
    some = np.maximum(words, 1)
    count = lambda mask: np.bincount(text[mask], minlength=n) / some
    h = hashes(data, s, length)
    twins = np.zeros(len(s), bool)
    twins[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    distinct, top, _ = _repeats(text, h, n, length)
    cols += [np.bincount(text, length, minlength=n) / some, count(length <= 3), count(length >= 12), distinct / some, top / some, count(twins)]
    s, e, at = runs(data != 10, offs)
    lines, length, text = np.diff(at), e - s, np.repeat(np.arange(n), np.diff(at))
    _, _, again = _repeats(text, hashes(data, s, length), n, length)
    return np.column_stack([*cols, again / safe, np.log1p(size / np.maximum(lines, 1))])


def _sums(bins: np.ndarray, n_bins: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(bins, v, minlength=n_bins) for v in values]


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps by bin, of the tree with the best first split and then the best split of either side."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four quadrants: its gain and the Newton steps by cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    gain = np.full((g.shape[0] - 1, g.shape[1] - 1), -_gain(cg[-1, -1], ch[-1, -1]))
    parts = []
    for c in (cg, ch):
        a = c[1:-1, 1:-1]
        b, d = c[1:-1, -1:] - a, c[-1:, 1:-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    for x, y in zip(*parts, strict=True):
        gain += _gain(x, y)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty_like(g, float)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gain[i, j]), step


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS):
        mean = float(y.mean()) if len(y) else 0.5
        clipped = min(max(mean, 1e-3), 1 - 1e-3)
        self.base = float(np.log(clipped / (1 - clipped)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
        self.tables, self.pairs = [np.zeros(len(c) + 1) for c in self.cuts], []
        if len(np.unique(y)) < 2:
            return
        b = self._bins(x)
        margin = np.full(len(y), self.base)

        def gradients():
            p = 1 / (1 + np.exp(-margin))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                step = rate * _tree(*_sums(b[f], len(table), *gradients()))
                table += step
                margin += step[b[f]]
        coarse = [np.unique(np.quantile(c, np.linspace(0, 1, 9)[1:-1])) for c in x.T]
        few = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T, strict=True)]
        cells = lambda i, j: few[i] * (len(coarse[j]) + 1) + few[j]
        grid = lambda i, j: [v.reshape(len(coarse[i]) + 1, -1) for v in _sums(cells(i, j), (len(coarse[i]) + 1) * (len(coarse[j]) + 1), *gradients())]
        wide = [f for f in range(len(few)) if len(coarse[f])]
        best = sorted(combinations(wide, 2), key=lambda ij: (-_quadrants(*grid(*ij))[0], ij))[:pairs]
        self.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in best]
        for _ in range(rounds // 2):
            for i, j, _, _, table in self.pairs:
                step = rate * _quadrants(*grid(i, j))[1]
                table += step
                margin += step.ravel()[cells(i, j)]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for table, b in zip(self.tables, self._bins(x) if self.cuts else [], strict=True):
            margin += table[b]
        for i, j, ci, cj, table in self.pairs:
            margin += table[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return 1 / (1 + np.exp(-margin))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """documents: doc_id, text; labels: doc_id and a 0/1 column. The sample is at most about max_rows labels."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("gam"), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = known.where(place < max_rows / max(n, 1))  # some 20,000 rows of 16 bytes, so it can be broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j, part, o in slices(data, offs):
                yield pa.RecordBatch.from_arrays([pa.array(features(part, o).tolist(), pa.list_(pa.float64())), b.column("y").slice(i, j - i)], names=["x", "y"])

    # in a fixed order: the sums of boosting depend on it in their last bits
    found = sorted((r["x"], r["y"]) for r in map_arrow(rows, measure, "x array<double>, y double").collect())
    return AdditiveModel(np.array([x for x, _ in found]).reshape(-1, len(FEATURES)), np.array([y for _, y in found]))


def predict(documents: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the rows of `documents` (columns of those names are replaced)."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    rest, body = documents.drop("score", "predicted"), own_name(documents, "body")
    names = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "score double", "predicted int"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(body))
            found = [held.value.scores(features(part, o)) for _, _, part, o in slices(data, offs)]
            s = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return map_arrow(rest.withColumn(body, F.coalesce("text", F.lit(""))), score, schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text").withColumn("held_out", holds_out(5, 0))
    model = train(docs, labels.where(~holds_out(5, 0)))
    return predict(docs, model).select("doc_id", "held_out", "score", "predicted")
