"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.common import fold

#: Hashed features: words and their first four, five and six letters.
BUCKETS = 1 << 18
#: Labelled documents of each label that are learned from at most (in expectation), by a hash of the id.
SAMPLE = 20_000
FOLDS = 5
#: Words that a worker remembers, at most.
REMEMBERED = 500_000
MARKS = b".,;:!?\"'()*&%$#|"
CATEGORIES = ("toxic", "severe", "pervasive")


class Words(dict):
    """A word's buckets (of the word and its first four, five and six bytes, A-Z lower-cased, marks around it cut), or
    their places among the chosen ones. Remembers each word it has seen, up to a number."""

    def __init__(self, chosen: np.ndarray | None = None) -> None:
        self.chosen = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        w = word.strip(MARKS)
        forms = dict.fromkeys([b"=" + w, *(b"%d" % n + w[:n] for n in (4, 5, 6) if len(w) > n)]) if w else ()
        found = tuple(mixed(zlib.crc32(f)) for f in forms)
        if self.chosen is not None:
            found = tuple(self.chosen[b] for b in found if b in self.chosen)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found
        return found


def mixed(code: int) -> int:
    return (code * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 46


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, known = np.zeros((2, BUCKETS), np.int64), Words()
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            total[label][list(set().union(*map(known.__getitem__, set((text.as_py() or b"").lower().split()))))] += 1
    at = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "clean", "toxic"])
    at = np.flatnonzero((total[0] > 0) & (total[1] == 0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "clean", "toxic"])


def hits(text: bytes, known: Words) -> tuple[list[int], list[int], int, int]:
    """Chosen features with their numbers, words in all, and lines with a hit."""
    counts, words, lines = Counter(), 0, 0
    for line in text.lower().split(b"\n"):
        found = line.split()
        words += len(found)
        if found := list(filter(None, map(known.__getitem__, found))):
            lines += 1
            for places in found:
                counts.update(places)
    kinds = sorted(counts)
    return kinds, [counts[k] for k in kinds], words, lines


def _hits(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for batch in batches:
            rows = [(i, y, *hits(t.as_py() or b"", known)) for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fold", "label", "kinds", "n", "words", "lines"])

    return extract


@dataclass
class Table:
    """Documents x features: the few that are not 0 of the first ``width`` columns, by row, and dense columns after them."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    width: int
    dense: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.dense), self.width + self.dense.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], len(self.dense)) + self.dense @ w[self.width :]

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.place, self.value * r[self.row], self.width), self.dense.T @ r])

    def __getitem__(self, some: np.ndarray) -> Table:
        at = some[self.row]
        return Table((np.cumsum(some) - 1)[self.row[at]], self.place[at], self.value[at], self.width, self.dense[some])


def table(kinds: list, n: list, words, lines, width: int) -> Table:
    """Documents x features: log numbers of the chosen features, hits in all, hits by words, lines with hits, one."""
    row = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
    counts = np.concatenate([np.asarray(c, np.int64) for c in n] or [np.empty(0, np.int64)])
    place = np.concatenate([np.asarray(k, np.int64) for k in kinds] or [np.empty(0, np.int64)])
    total = np.bincount(row, counts, len(kinds))
    dense = np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(1, words)), np.log1p(lines), np.ones(len(kinds))], 1)
    return Table(row, place, np.log1p(counts), width, dense)


def beside(x: np.ndarray | Table, column: np.ndarray) -> np.ndarray | Table:
    """``x`` with one more column."""
    if isinstance(x, Table):
        return Table(x.row, x.place, x.value, x.width, np.hstack([x.dense, column[:, None]]))
    return np.hstack([x, column[:, None].astype(np.float32)])


def logistic(x: np.ndarray | Table, y: np.ndarray, rounds: int = 120, rate: float = 0.1, penalty: float = 3e-4) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        r = sigmoid(x @ w) - y
        g = (x.turned(r) if isinstance(x, Table) else x.T @ r) / max(1, len(y)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(x: np.ndarray | Table, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """A weight vector per category. In training, a later model sees earlier probabilities from models that did not
    learn from the row's own fold, as it will see them for texts that none has learned from."""
    chain = []
    for y in labels.T:
        chain.append(logistic(x, y))
        out = np.zeros(len(y))
        for k in np.unique(folds):
            other = folds != k
            w = logistic(x[other], y[other]) if other.any() else chain[-1]
            out[~other] = sigmoid(x[~other] @ w)
        x = beside(x, out)
    return chain


def apply_chain(x: np.ndarray | Table, chain: list[np.ndarray]) -> np.ndarray:
    out = []
    for w in chain:
        out.append(sigmoid(x @ w))
        x = beside(x, out[-1])
    return np.stack(out, 1)


@dataclass
class Model:
    chosen: np.ndarray
    chain: list[np.ndarray]


def fitted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns the categories from one label. Features are counted by Spark over about ``sample`` documents of each
    label, and all kept that are surely, and at least five times, as frequent in toxic documents as in clean ones. ``severe``: toxic, and at
    least the toxic documents' median of hits by words; ``pervasive``: toxic, with hits in several lines. Null labels are
    none; of several labels of an id the greatest counts. The driver gathers the counts of the buckets (a fixed
    number, which bounds the features too) and the sample's hits."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    part = F.xxhash64(F.lit("toxicity"), F.col(id)).cast("double") / 2.0**64 + 0.5
    share = F.when(F.col("_label") == 1, sample / max(1, counts.get(1, 0))).otherwise(sample / max(1, counts.get(0, 0)))
    rows = docs.select(F.col(id), F.col(text).alias("_text")).join(F.broadcast(known.where(part < share)), id)
    rows = rows.select(fold(id, FOLDS).alias("fold"), F.col("_label").cast("long").alias("label"), F.col("_text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 1")
    found = found.toPandas().sort_values("bucket")
    n = [max(1, min(sample, counts.get(k, 0))) for k in (0, 1)]
    p, q = found["toxic"] / n[1], found["clean"] / n[0]
    both = (found["toxic"] + found["clean"]) / sum(n)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chosen = np.sort(found["bucket"][(z > 6) & (p > 5 * q)].to_numpy(np.int64))
    if not len(chosen):
        return Model(np.array([-1]), [])
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    s = rows.mapInArrow(_hits(shared), "fold long, label long, kinds array<int>, n array<int>, words long, lines long").toPandas()
    key = [(*r[:2], *r[4:], *(np.asarray(x, np.int64).tobytes() for x in r[2:4])) for r in s.itertuples(index=False)]
    s = s.iloc[sorted(range(len(s)), key=key.__getitem__)]  # whatever order they came in
    x = table(s["kinds"], s["n"], s["words"].to_numpy(), s["lines"].to_numpy(), len(chosen))
    y = s["label"].to_numpy(int)
    dense = x.dense[:, 1]
    middle = np.median(dense[y == 1])
    return Model(chosen, fit_chain(x, np.stack([y, y * (dense >= middle), y * (s["lines"].to_numpy() > 1)], 1), s["fold"].to_numpy()))


def _score(shared, least: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Words(model.chosen)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                if model.chain:
                    k, n, words, lines = zip(*(hits(t.as_py() or b"", known) for t in some.column(0)))
                    p = apply_chain(table(k, n, words, lines, len(model.chosen)), model.chain)
                else:
                    p = np.zeros((some.num_rows, len(CATEGORIES)))
                columns = some.columns[1:] + [pa.array(p[:, 0]), pa.array((p[:, 0] >= least).astype(np.int32)), pa.array(p[:, 1]), pa.array(p[:, 2])]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[1:] + ["score", "predicted", "severe", "pervasive"])

    return score


def scored(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with score (of toxic), predicted (1 if at least ``least``), and the probabilities severe and pervasive;
    such columns are replaced. Null and empty texts have no hits. Without labels of both kinds, or features that tell
    them apart, all probabilities are 0. Rows don't move."""
    docs = docs.drop("score", "predicted", "severe", "pervasive")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*docs.columns).schema.add("score", "double").add("predicted", "integer").add("severe", "double").add("pervasive", "double")
    return docs.select(F.col(text).cast("binary").alias("__text"), *docs.columns).mapInArrow(_score(shared, least), schema)
