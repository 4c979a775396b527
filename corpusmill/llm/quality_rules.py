"""Quality rules: logistic regression over hashed word and character n-grams, calibrated, against fixed thresholds.

Two heads are trained on labelled rows: whether a document is good and whether it is toxic.  Features are the presence of
hashed word unigrams and bigrams, of words repeated four times over, and of byte 4-grams.  Features that aren't associated with the label
beyond chance (|z| under MIN_Z in MIN_ROWS rows or more) have weight 0, whatever their number; a logistic regression weighs the others, and Platt
scaling on rows that it wasn't trained on turns its scores into probabilities.  Documents are scored in Arrow batches: no row of text becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, hash60, map_arrow, table, written
from corpusmill.llm.tokens import as_strings, buffers, combine, mix, pieces, words

#: Labelled rows that the model is fitted on: about so many, those whose id hashes are lowest.
TRAIN_ROWS = 6000
#: One fitted row in so many calibrates instead of training.
CALIBRATE = 4
BITS = 22
#: Rows that a feature must be in and the association with the label that it must have to be weighed.
MIN_ROWS, MIN_Z = 4, 4.0
#: Fixed thresholds on the calibrated probabilities.
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5

_SALTS = {"word": np.uint64(0xD6E8FEB86659FD93), "pair": np.uint64(0xA5CB9243E1F1C4A5), "repeat": np.uint64(0x2545F4914F6CDD1D)}


def _bucket(h: np.ndarray, kind: str) -> np.ndarray:
    return (mix(h + _SALTS[kind]) >> np.uint64(64 - BITS)).astype(np.int32)


def features(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, [(buckets, bounds)]): row first+i has buckets[bounds[i]:bounds[i+1]] of each kind, with repeats."""
    for a, b, h, at in words(column):
        found = [(_bucket(h, "word"), at)]
        for n, kind in ((2, "pair"), (4, "repeat")):
            size = np.maximum(np.diff(at) - n + 1, 0)
            bounds = np.concatenate([[0], np.cumsum(size)])
            if not bounds[-1]:
                continue
            start = np.repeat(at[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
            if kind == "pair":
                found.append((_bucket(combine(h[start], h[start + 1]), "pair"), bounds))
            else:
                same = (h[start] == h[start + 1]) & (h[start] == h[start + 2]) & (h[start] == h[start + 3])
                total = np.concatenate([[0], np.cumsum(same)])
                found.append((_bucket(np.zeros(int(total[-1]), np.uint64), "repeat"), total[bounds]))
        yield a, b, found
    strings = as_strings(column)
    for a, b in pieces(strings):
        raw, offsets = buffers(strings.slice(a, b - a))
        if len(raw) < 4:
            continue
        h = np.ndarray(len(raw) - 3, dtype="<u4", buffer=np.ascontiguousarray(raw), strides=(1,)) * np.uint32(2654435761)
        buckets = ((h ^ np.uint32(0x5BD1E995)) >> np.uint32(32 - BITS)).astype(np.int32)
        # 4-grams across two texts belong to neither: they are given to an empty range
        yield a, b, [(np.append(buckets, [-1, -1, -1]), offsets)]


def presence(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features of ``chosen`` (feature by bucket, -1 for none) that each row has, each once."""
    rows, cols = [], []
    for a, b, found in features(column):
        for buckets, bounds in found:
            f = chosen[buckets]
            f[buckets < 0] = -1
            if len(bounds) > 1 and len(buckets) and bounds[-1] == len(buckets) and (buckets[-1:] < 0).any():
                for k in (1, 2, 3):
                    f[np.maximum(bounds[1:] - k, 0)] = -1
            at = np.flatnonzero(f >= 0)
            if not len(at):
                continue
            row = np.searchsorted(bounds, at, side="right") - 1 + a
            code = np.unique(row.astype(np.int64) * len(chosen) + f[at])
            rows.append(code // len(chosen))
            cols.append(code % len(chosen))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


@dataclass
class Head:
    """A head: probability 1 / (1 + exp(-(scale * (bias + sum of weights) + shift)))."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, column: pa.Array) -> np.ndarray:
        return Heads([self]).probabilities(column)[0]


class Heads:
    """Several heads, whose features are found in one pass over the texts."""

    def __init__(self, heads: list[Head]) -> None:
        self.scales = [(h.bias, h.scale, h.shift) for h in heads]
        used = np.flatnonzero(np.any([h.chosen >= 0 for h in heads], axis=0))
        self.chosen = np.full(1 << BITS, -1, np.int32)
        self.chosen[used] = np.arange(len(used))
        self.weights = [np.where(h.chosen[used] >= 0, h.weights[h.chosen[used]], 0.0) for h in heads]

    def probabilities(self, column: pa.Array) -> list[np.ndarray]:
        rows, cols = presence(column, self.chosen)
        out = []
        for (bias, scale, shift), w in zip(self.scales, self.weights, strict=True):
            logit = bias + (np.bincount(rows, weights=w[cols], minlength=len(column)) if len(cols) else np.zeros(len(column)))
            out.append(1.0 / (1.0 + np.exp(-np.clip(scale * logit + shift, -30, 30))))
        return out


def _rows_with(column: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows with label 1 and with label 0 have each bucket."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    everything = np.arange(1 << BITS, dtype=np.int32)
    for a, b in pieces(as_strings(column)):
        some = y[a:b]
        rows, cols = presence(column.slice(a, b - a), everything)
        # a bucket that several kinds of features share comes once for each
        code = np.unique(rows << BITS | cols)
        del rows, cols
        for k in (0, 1):
            buckets, n = np.unique(code[some[code >> BITS] == k] & ((1 << BITS) - 1), return_counts=True)
            counts[k][buckets] += n.astype(np.int32)
    return counts[1], counts[0]


def fit(texts: pa.Array, y: np.ndarray, calibrates: np.ndarray) -> Head:
    """A head trained on the rows that don't calibrate; with one class only, its probability is that class's everywhere."""
    none = np.full(1 << BITS, -1, np.int32)
    train = ~calibrates
    n1, n0 = int((y[train] == 1).sum()), int((y[train] == 0).sum())
    if not n1 or not n0:
        return Head(none, np.zeros(1), 0.0, 1.0, 30.0 if n1 else -30.0)
    with1, with0 = _rows_with(texts.filter(pa.array(train)), y[train])
    some = np.flatnonzero(with1 + with0 >= MIN_ROWS)
    with1, with0 = with1[some], with0[some]
    p1, p0 = (with1 + 0.5) / (n1 + 1), (with0 + 0.5) / (n0 + 1)
    p = (with1 + with0 + 1.0) / (n1 + n0 + 2)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    best, r = some[z >= MIN_Z], np.log(p1 / p0)[z >= MIN_Z]
    chosen = none.copy()
    chosen[best] = np.arange(len(best))
    # a row and feature for each that is there
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a, b in pieces(as_strings(texts)):
        row, col = presence(texts.slice(a, b - a), chosen)
        code = np.unique((row + a) * max(1, len(best)) + col)
        rows.append((code // max(1, len(best))).astype(np.int32))
        cols.append((code % max(1, len(best))).astype(np.int32))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    number = np.cumsum(train) - 1
    mine = train[rows]
    w, bias = _regress(number[rows[mine]], cols[mine], r, y[train].astype(float))
    logit = np.bincount(rows, w[cols], len(texts)) + bias if len(cols) else np.full(len(texts), bias)
    scale, shift = _platt(logit[calibrates], y[calibrates])
    return Head(chosen, w if len(w) else np.zeros(1), bias, scale, shift)


def _regress(rows: np.ndarray, cols: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by accelerated gradient steps.

    A feature's value is ``r``, the log ratio of its rates, where it is present (rows, cols), so that the penalty on the weights of these values
    holds the features that say little closer to 0; the weights returned are for presence.
    """
    n, d = len(y), len(r)
    each = np.bincount(rows, minlength=n)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, (v * r)[cols], n) if len(cols) else np.zeros(n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(cols, np.repeat(g, each), d) * r if len(cols) else np.zeros(d)

    v, norm = np.ones(d) / np.sqrt(max(d, 1)), 1.0
    for _ in range(20):
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / (0.25 * (norm / n + 1.0) + l2)
    w = u = np.zeros(d)
    c = bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for k in range(rounds):
        g = (1.0 / (1.0 + np.exp(-np.clip(times(u) + c, -30, 30))) - y) / n
        w_, c_ = u - step * (back(g) + l2 * u), c - step * float(g.sum())
        m = k / (k + 3.0)
        u, c = w_ + m * (w_ - w), c_ + m * (c_ - bias)
        w, bias = w_, c_
    return w * r, bias


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the scores probabilities, with Platt's smoothed targets; (1, 0) without both classes."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g = np.array([((p - t) * logit).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * logit * logit).sum() + 1e-3, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text") -> tuple[Head, Head]:
    """(quality head, toxic head), fitted on about ``rows`` labelled rows with the lowest id hashes; a label that is null or contradicts another one of its document counts for neither side of its own head."""
    flat = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.when(F.min(c) == F.max(c), F.min(c)).alias(n) for c, n in (("quality", "q"), ("toxic", "t"))]).where("q IS NOT NULL OR t IS NOT NULL")
    flat = written(flat.select(F.col("doc_id").alias("label_id"), "q", "t", hash60("doc_id").alias("h")), "labels")
    n = flat.count()
    some = flat.where(F.col("h") < int(min(1.0, rows / max(n, 1)) * (1 << 60)))
    found = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").join(checked_broadcast(some), F.col("doc_id") == F.col("label_id")).select("text", "q", "t", "h").toArrow()
    found = found.sort_by([("h", "ascending"), ("text", "ascending")])
    texts, h = as_strings(found["text"]), found["h"].to_numpy()
    heads = []
    for c in ("q", "t"):
        known = found[c].is_valid().to_numpy()
        heads.append(fit(texts.filter(pa.array(known)), found[c].to_numpy()[known].astype(int), h[known] % CALIBRATE == 0))
    return heads[0], heads[1]


def apply_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, quality, toxic, keep) for each row of ``docs``: calibrated probabilities to four decimals, and whether both are within the fixed thresholds.

    Null texts count as empty; those have no features, so their probabilities are the heads' biases.  Whole texts are
    scored, however long, and repeated rows each.  With labels of one class only, a head answers with that class; without any, with 0.  A
    probability at a threshold keeps the row.  An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    quality, toxic = train(docs, labels, rows, id, text)
    heads = docs.sparkSession.sparkContext.broadcast(Heads([quality, toxic]))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = (np.round(p, 4) for p in heads.value.probabilities(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(t), pa.array((q >= MIN_QUALITY) & (t <= MAX_TOXIC))], ["doc_id", "quality", "toxic", "keep"])

    return map_arrow(docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, quality double, toxic double, keep boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass both rules, with their probabilities."""
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")
