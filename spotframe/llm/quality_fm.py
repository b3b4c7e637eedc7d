"""Quality classifier: a factorisation machine over hashed words, structure statistics and
size.

A text's features x are its lower-cased words (split at white space) hashed into ``SLOTS``
slots with log counts of unit length, standardised statistics of its structure, and the
binary order of its size in code points as one slot each.  The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so the pairwise interactions of all features cost time linear in their number.

The model is fitted in one task on at most ``SAMPLE`` labelled rows outside the held-out
fold (crc32 of doc_id as text, modulo 5, is 0 there); doc_id, lang, source and labels are
no inputs of a score.  Rows are taken by a hash of doc_id, so the sample is the same on
every run.  All documents are scored, on whole texts, where they lie.

A null text counts as empty; an empty text has a score as well.  A null doc_id is held out.
Labels without quality or doc_id are not learned from; where a doc_id is labelled twice
the higher label counts.  Without any label to learn from every score is 0.5; with labels
of one class the scores lie near that class.  A table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import text_of
from spotframe.llm.tokenize import by_chars

SAMPLE = 6000
SLOTS, RANK = 1 << 16, 8
THRESHOLD = 0.3
SIZES = 32
_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _WIDE = range(8)
STATISTICS = 20


def _byte_classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    table[128:] = _WIDE
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", _LETTER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
                        (b"0123456789", _DIGIT), (b" \t\r", _SPACE), (b"\n", _LINE), (b".,;:!?'\"()-", _STOP)):
        table[list(chars)] = kind
    return table


_CLASSES = _byte_classes()


@dataclass
class Features:
    """Sparse rows: ``slot`` and ``value`` of document i lie in start[i]:start[i + 1]."""
    start: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    statistics: np.ndarray      # documents x STATISTICS, not yet standardised
    size: np.ndarray            # binary order of the code points, under SIZES


def features(texts: list[str]) -> Features:
    n = len(texts)
    stats = np.zeros((n, STATISTICS))
    for i, t in enumerate(texts):
        body = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        share = np.bincount(_CLASSES[body], minlength=8) / max(1, len(body))
        lines = t.split("\n")
        stats[i, :8] = share
        stats[i, 8] = share[_UPPER] / max(1e-9, share[_UPPER] + share[_LETTER])
        stats[i, 9] = np.log1p(len(body) / len(lines))
        stats[i, 10] = 1 - len(set(lines)) / len(lines)
        stats[i, 11] = t.count("|") / max(1, len(lines[0]) + 1, len(body))
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(n), count)
    size = np.minimum(SIZES - 1, np.array([len(t).bit_length() for t in texts], np.int64))
    if not len(doc):
        return Features(np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0), stats, size)
    code, names = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    low = np.array([w.lower() for w in names], dtype=object)
    kinds = np.array([(w.isupper(), not w[-1].isalnum(), not w.isalpha(), len(w)) for w in names], np.float64)
    total = np.maximum(count, 1)
    for k in range(3):
        stats[:, 12 + k] = np.bincount(doc, kinds[code, k], n) / total
    stats[:, 15] = np.bincount(doc, kinds[code, 3], n) / total
    stats[:, 16] = np.log1p(count)
    again = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    stats[:, 17] = np.bincount(doc[1:][again], minlength=n) / total
    # one entry per document and distinct word
    key, times = np.unique(doc * len(names) + code, return_counts=True)
    doc, code = key // len(names), key % len(names)
    stats[:, 18] = np.bincount(doc, minlength=n) / total
    top = np.zeros(n)
    np.maximum.at(top, doc, times)
    stats[:, 19] = top / total
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(doc, value ** 2, n))[doc]
    slot = (pd.util.hash_array(low, categorize=False) % np.uint64(SLOTS)).astype(np.int64)[code]
    return Features(np.append(0, np.cumsum(np.bincount(doc, minlength=n))), slot, value, stats, size)


def joined(parts: list[Features]) -> Features:
    """The rows of several parts as one."""
    ends = np.cumsum([0, *(len(p.slot) for p in parts)])
    start = np.concatenate([p.start[:-1] + e for p, e in zip(parts, ends)] + [ends[-1:]]).astype(np.int64)
    return Features(start, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("slot", "value", "statistics", "size")))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray          # SLOTS + SIZES + STATISTICS
    factors: np.ndarray         # the same x RANK
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, slot, value) with size and standardised statistics after the words."""
        n = len(f.size)
        extra = STATISTICS + 1
        dense = np.clip((f.statistics - self.mean) / self.spread, -5, 5) / 4
        slot = np.empty(len(f.slot) + n * extra, np.int64)
        value = np.empty(len(slot))
        width = np.diff(f.start)
        start = f.start + extra * np.arange(n + 1)
        own = np.repeat(np.arange(n), width)
        at = np.arange(len(f.slot)) + extra * own
        slot[at], value[at] = f.slot, f.value
        tail = (start[1:] - extra)[:, None] + np.arange(extra)
        slot[tail[:, 0]], value[tail[:, 0]] = SLOTS + f.size, 0.5
        slot[tail[:, 1:]] = SLOTS + SIZES + np.arange(STATISTICS)
        value[tail[:, 1:]] = dense
        return start, slot, value

    def margin(self, start: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of every row and its sums of factors; no row is without features."""
        vx = self.factors[slot] * value[:, None]
        sums = np.add.reduceat(vx, start[:-1])
        squares = np.add.reduceat((vx ** 2).sum(1), start[:-1])
        line = np.add.reduceat(self.linear[slot] * value, start[:-1])
        return self.bias + line + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def packed(self) -> pa.RecordBatch:
        """One row: bias, linear and factor weights as float32, mean and spread as float64."""
        weights = np.concatenate([self.linear, self.factors.ravel()]).astype("<f4")
        scaling = np.concatenate([self.mean, self.spread]).astype("<f8")
        return pa.RecordBatch.from_arrays([pa.array([float(self.bias)]), pa.array([weights.tobytes()]), pa.array([scaling.tobytes()])],
                                          names=["bias", "weights", "scaling"])

    @classmethod
    def unpacked(cls, bias: float, weights: bytes, scaling: bytes) -> FactorisationMachine:
        w, s = np.frombuffer(weights, "<f4"), np.frombuffer(scaling, "<f8")
        width = len(w) // (RANK + 1)
        return cls(bias, w[:width], w[width:].reshape(width, RANK), s[:STATISTICS], s[STATISTICS:])

    def probability(self, f: Features) -> np.ndarray:
        if not len(f.size):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(f))[0], -30, 30)))


def train(f: Features, label: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.1,
          decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, minibatches, per-weight step sizes (Adagrad)."""
    rng = np.random.default_rng(seed)
    width = SLOTS + SIZES + STATISTICS
    model = FactorisationMachine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK)),
                                 np.zeros(STATISTICS), np.ones(STATISTICS))
    if not len(label):
        model.factors[:] = 0
        return model
    model.mean, model.spread = f.statistics.mean(0), np.maximum(f.statistics.std(0), 1e-6)
    base = np.clip(label.mean(), 0.01, 0.99)
    model.bias = float(np.log(base / (1 - base)))
    start, slot, value = model.rows(f)
    seen_w, seen_v, seen_b = np.full(width, 1e-3), np.full((width, RANK), 1e-3), 1e-3
    for _ in range(rounds):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            n = start[some + 1] - start[some]
            at = np.repeat(start[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            own = np.repeat(np.arange(len(some)), n)
            s, x = slot[at], value[at]
            m, sums = model.margin(np.append(0, np.cumsum(n)), s, x)
            error = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - label[some]) / len(some)
            g = (error[own] * x)[:, None]
            used, back = np.unique(s, return_inverse=True)
            gw = np.bincount(back, g[:, 0], len(used)) + decay * model.linear[used]
            gv = np.zeros((len(used), RANK))
            np.add.at(gv, back, g * (sums[own] - model.factors[s] * x[:, None]))
            gv += decay * model.factors[used]
            seen_w[used] += gw ** 2
            seen_v[used] += gv ** 2
            seen_b += error.sum() ** 2
            model.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` rows of ``docs(doc_id, text)`` labelled by
    ``labels(doc_id, quality)``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna()
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # at most ``sample`` pairs of numbers are broadcast
    got = (texts.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
           .select("text", "quality"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, label = [], []
        for batch in batches:
            body = batch.column("text").to_pylist()
            parts += [features(body[a:b]) for a, b in by_chars(body)]
            label += batch.column("quality").to_pylist()
        if label:
            yield train(joined(parts), (np.array(label) > 0).astype(float)).packed()

    # the sample lies in one partition and is learned from there; weights alone come back
    rows = got.mapInArrow(learn, "bias double, weights binary, scaling binary").collect()
    return FactorisationMachine.unpacked(*rows[0]) if rows else train(features([]), np.empty(0))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("text").to_pylist()
            for a, b in by_chars(body):
                got = model.probability(features(body[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(got, pa.float64())],
                                                 names=["doc_id", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored under the threshold; all columns as they were."""
    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        body = texts.tolist()
        return pd.Series(np.concatenate([np.empty(0), *(model.probability(features(body[a:b]))
                                                        for a, b in by_chars(body))]))
    return docs.filter(probability(text_of()) >= threshold)
