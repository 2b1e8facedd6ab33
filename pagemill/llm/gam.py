"""A generalised additive model with pairwise interactions on text features.

Cyclic boosting of shallow trees over binned features learns one lookup table
for each feature and then one for each of the strongest feature pairs. A score is a sum of
table entries, looked up by bin for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import SPACE, U64, mix, prefix_hash, range_hash, slices, tidy, words
from pagemill.llm.spark import batch, cut, least_hashed, runs

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "punctuation", "wide", "blank", "line_length", "dup_lines", "distinct_words", "top_word", "entropy", "end_stops", "long_words", "repeat_windows")
_UPPER, _DIGIT, _LOWER = np.zeros((3, 256))
_UPPER[65:91] = _DIGIT[48:58] = _LOWER[97:123] = 1
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>~^=+_\\/@{}[]", np.uint8)).astype(float)
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8)).astype(float)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, over whole texts; an empty text is all zeros."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    own = np.repeat(np.arange(n), np.diff(off))
    count = np.bincount(own.astype(np.int64) * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = count / size[:, None]
    out = np.zeros((n, len(FEATURES)))
    start, end, word_own = words(data, off)
    n_words = np.bincount(word_own, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    length = (end - start).astype(float)
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = np.bincount(word_own, weights=length, minlength=n) / some
    out[:, 2], out[:, 3], out[:, 4], out[:, 5] = share @ _UPPER, share @ _DIGIT, share @ _SYMBOL, share @ _STOP
    out[:, 6] = share[:, 128:].sum(1)
    out[:, 7] = share[:, SPACE].sum(1)
    lines = count[:, 10] + 1
    out[:, 8] = np.log1p(size / lines)
    # repeated lines, words and windows, by hash
    h = prefix_hash(data)
    cuts = np.union1d(off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1)
    cuts = cuts[cuts < len(data)]
    if len(cuts):
        stop = np.append(cuts[1:], len(data))
        line_own = np.searchsorted(off, cuts, "right") - 1
        out[:, 9] = _repeats(range_hash(h, cuts, stop - (data[stop - 1] == 10)), line_own, n)[0]
        out[:, 13] = np.bincount(line_own, weights=np.isin(data[np.maximum(stop - 1 - (data[stop - 1] == 10), cuts)], np.frombuffer(b".!?", np.uint8)), minlength=n) / np.maximum(np.bincount(line_own, minlength=n), 1)
    if len(start):
        w = range_hash(h, start, end)
        rep, top = _repeats(w, word_own, n)
        out[:, 10], out[:, 11] = 1 - rep, top
        same = np.flatnonzero(word_own[4:] == word_own[:-4]) if len(w) > 4 else np.zeros(0, np.int64)
        if len(same):
            g = mix(w[same] + w[same + 1] * U64(3) + w[same + 2] * U64(5) + w[same + 3] * U64(7) + w[same + 4] * U64(9))
            out[:, 15] = _repeats(g, word_own[same], n)[0]
    out[:, 12] = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    out[:, 14] = np.bincount(word_own, weights=length > 12, minlength=n) / some
    out[n_words == 0] = 0
    return out


def _repeats(h: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of an owner's hashes that repeat an earlier one, and of its commonest hash."""
    o = np.lexsort((h, own))
    key = h[o] ^ mix(own[o].astype(U64))
    at = runs(key)
    size = np.diff(np.append(at, len(key)))
    total = np.bincount(own, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, own[o][at], size)
    return (total - np.bincount(own[o][at], minlength=n)) / np.maximum(total, 1), top / np.maximum(total, 1)


@dataclass
class Gam:
    """Intercept, bin edges, a table per feature, and (i, j, table) per pair on coarse bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, f], "right")]
        c = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        for i, j, t in self.pairs:
            out += t[c[i], c[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of one feature on gradient and hessian sums by bin: the value of each bin."""
    cuts, n = [], len(g)
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    value = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        bounds = [0, *sorted(cuts), n]
        for a, b in zip(bounds, bounds[1:]):
            c = np.arange(a + 1, b)
            if len(c):
                gain = value(a, c) + value(c, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(c[k]))
        if best[1] is None:
            break
        cuts.append(best[1])
    out = np.zeros(n)
    bounds = [0, *sorted(cuts), n]
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, coarse: int = 8, pairs: int = 6, pair_rounds: int = 60, ridge: float = 5.0) -> Gam:
    """Learn main effects by cyclic boosting, then the pairs with the largest gain on what is left.

    Labels of one class only, or none, give a constant model.
    """
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(prior / (1 - prior))), [_edges(x[:, f], bins) if n else np.zeros(0) for f in range(d)], [], [_edges(x[:, f], coarse) if n else np.zeros(0) for f in range(d)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    b = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    c = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    m = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-m))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(b[f], g, k), np.bincount(b[f], h, k), 3, ridge)
            model.tables[f] += step
            m += step[b[f]]
    g, h = slopes()
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            k = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            at = c[i] * k[1] + c[j]
            gg, hh = np.bincount(at, g, k[0] * k[1]), np.bincount(at, h, k[0] * k[1])
            gains.append((float((gg * gg / (hh + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        k = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        model.pairs.append((i, j, np.zeros(k)))
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            at = c[i] * t.shape[1] + c[j]
            gg, hh = np.bincount(at, g, t.size).reshape(t.shape), np.bincount(at, h, t.size).reshape(t.shape)
            # a shallow tree: split the rows of the table in three, each part's columns in three
            rows = _tree(gg.sum(1), hh.sum(1), 3, ridge)
            step = np.zeros(t.shape)
            for v in np.unique(rows):
                r = rows == v
                step[r] = _tree(gg[r].sum(0), hh[r].sum(0), 3, ridge)[None, :]
            t += rate * step
            m += rate * step.reshape(-1)[at]
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, most=2 << 20):
        x = features(data, off)
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.reshape(-1))
        yield batch({"doc_id": rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), "x": lists}, _OUT)


def fold(doc_id) -> object:
    """crc32 of the id as text, mod 5: rows of remainder 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(rows: DataFrame, labels: DataFrame, most: int = 20_000, label: str = "quality") -> Gam:
    """Fit on at most ``most`` labelled rows outside the held-out fold (those of least id hash)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(fold(F.col("id")) != 0).distinct()
    known = cut(least_hashed(known, "id", most, "y"))
    got = rows.join(known, F.col("doc_id") == F.col("id")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").select("x", "y").limit(most).toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels outside the held-out fold only are learned from, at most ``most``; null
    labels are left out. The score depends on the text alone; null and empty texts
    are all-zero feature rows and get the score of such rows. Repeated rows get a
    row each; a row without doc_id is scored, and held out (null fold counts as such).
    With no usable labels every score is 0.5.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_features), "doc_id long, x array<double>"))
    model = train(rows, labels, most, label)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
