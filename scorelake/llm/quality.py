"""Document quality: a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled documents of each label that are learned from at most (in expectation), by a hash of the id.
SAMPLE = 6_000
#: Features of a line; its neighbours' follow, and a constant.
OWN = 11
ASCII = bytes(range(128))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
CAPITALS, DIGITS, BLANKS = LETTERS[:26], b"0123456789", b" \t\r\x0b\x0c"
STOPS = b".,;:'\"-()?"


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths in bytes) of all lines; blank lines are left out, and a text without any has one of
    length 1. Features: log length; shares of capitals, digits, stops and other marks; words' mean length; share of
    distinct words, of words equal to the one before, of one-character words; a stop at the end; seen before."""
    rows, lengths, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, letters = len(line), len(line) - len(line.translate(None, LETTERS))
        capitals, digits, stops = (n - len(line.translate(None, c)) for c in (CAPITALS, DIGITS, STOPS))
        other = n - letters - digits - stops - len(line.translate(None, ASCII)) - (n - len(line.translate(None, BLANKS)))
        k = len(words)
        rows.append((
            np.log1p(n), capitals / n, digits / n, stops / n, other / n, np.log(n / k), len(set(words)) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k, sum(len(w) == 1 for w in words) / k, words[-1][-1:] in (b".", b"?", b"!"), line in seen,
        ))
        seen.add(line)
        lengths.append(n)
    if not rows:
        rows, lengths = [(0.0,) * OWN], [1]
    own = np.array(rows, np.float32)
    edge = np.zeros((1, OWN), np.float32)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1), np.float32)]), np.array(lengths)


@dataclass
class Field:
    """States 0 (bad) and 1 (good): a line's score for good, and scores of the four steps from line to line."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        out: list = [None] * len(docs)
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        while order:  # so many alike long ones at once that the padded table stays small
            width = max(1, min(len(order), 200_000 // len(docs[order[-1]])))
            part, order = order[-width:], order[:-width]
            states = self._both([docs[i] for i in part])[0]
            for i, p in zip(part, states):
                out[i] = p[: len(docs[i]), 1]
        return out

    def _both(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of lines and expected steps (documents x 2 x 2), padded; also which lines are there."""
        n = np.array([len(d) for d in docs])
        unary, there = np.zeros((len(docs), n.max(), 2)), np.arange(n.max()) < n[:, None]
        for i, d in enumerate(docs):
            unary[i, : len(d), 1] = ((d - self.mean) / self.scale) @ self.weights
        go = np.exp(self.steps - self.steps.max())
        local = np.exp(unary - unary.max(2, keepdims=True))
        ahead, back = np.empty_like(local), np.empty_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
        for t in range(1, local.shape[1]):
            a = (ahead[:, t - 1] @ go) * local[:, t]
            ahead[:, t] = a / a.sum(1, keepdims=True)
        back[:, -1] = 1
        for t in range(local.shape[1] - 2, -1, -1):
            b = (back[:, t + 1] * local[:, t + 1]) @ go.T
            back[:, t] = np.where(there[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        both = ahead * back
        both /= both.sum(2, keepdims=True)
        pair = ahead[:, :-1, :, None] * go * (local * back)[:, 1:, None, :]
        pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
        return both, (pair * there[:, 1:, None, None]).sum(1), there


def fit_field(docs: list[np.ndarray], labels: np.ndarray, rounds: int = 12, rate: float = 0.05, penalty: float = 1e-3, seed: int = 3) -> Field:
    """Maximum likelihood where each line has its document's label, lines of a document counting one in all for the
    lines and one for the steps; both labels weigh alike. Adam over batches of documents of similar length."""
    if not docs:
        width = 3 * OWN + 1
        return Field(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    every = np.vstack([d[:: max(1, len(d) // 50)] for d in docs])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    field = Field(mean, scale, np.zeros(every.shape[1]), np.eye(2))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    order, rng = np.argsort([len(d) for d in docs], kind="stable"), np.random.default_rng(seed)
    batches = [order[i : i + 64] for i in range(0, len(order), 64)]
    size = every.shape[1] + 4
    m, v, turn = np.zeros(size), np.zeros(size), 0
    for _ in range(rounds):
        for k in rng.permutation(len(batches)):
            at = batches[k]
            part, y, w = [docs[i] for i in at], labels[at], weight[at]
            both, steps, there = field._both(part)
            n = there.sum(1)
            off = (y[:, None] - both[:, :, 1]) * there * (w / n)[:, None]
            grad = sum(((d - mean) / scale).T @ o[: len(d)] for d, o in zip(part, off)) / len(at)
            told = np.zeros_like(steps)
            told[np.arange(len(at)), y, y] = n - 1
            turns = ((told - steps) * (w / n)[:, None, None]).sum(0) / len(at)
            g = np.concatenate([grad - penalty * field.weights, (turns - penalty * field.steps).ravel()])
            turn += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
            field.weights += move[:-4]
            field.steps = np.clip(field.steps + move[-4:].reshape(2, 2), -4, 4)
    return field


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_features(t.as_py() or b"")[0].astype("<f4").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "lines"])


def fitted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """Learns from about ``sample`` documents of each label. ``labels``: (id, label 0 or 1); a null label is none, and
    of several labels of an id the greatest counts. Features are made by Spark and gathered for the sample alone."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    part = F.xxhash64(F.lit("quality"), F.col(id)).cast("double") / 2.0**64 + 0.5
    chosen = known.where(part < F.when(F.col("_label") == 1, sample / max(1, counts.get(1, 0))).otherwise(sample / max(1, counts.get(0, 0))))
    rows = docs.select(F.col(id), F.col(text).alias("_text")).join(F.broadcast(chosen), id).select(F.col("_label").cast("long").alias("label"), F.col("_text").cast("binary").alias("text"))
    found = rows.mapInArrow(_extract, "label long, lines binary").toPandas()
    lines = [np.frombuffer(x, "<f4").reshape(-1, 3 * OWN + 1) for x in found["lines"]]
    order = sorted(range(len(lines)), key=lambda i: (len(lines[i]), lines[i].tobytes(), found["label"][i]))  # whatever order they came in
    return fit_field([lines[i] for i in order], found["label"].to_numpy(int)[order])


def _score(shared, least: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [line_features(t.as_py() or b"") for t in some.column(0)]
                scores, bad = [], []
                for p, (_, n) in zip(field.marginals([x for x, _ in found]), found):
                    scores.append(float(np.clip((p * n).sum() / n.sum(), 0, 1)))
                    bad.append(int((p < 0.5).sum()))
                lines = [len(n) for _, n in found]
                columns = some.columns[1:] + [pa.array(scores), pa.array([int(s >= least) for s in scores], pa.int32()), pa.array(lines, pa.int64()), pa.array(bad, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[1:] + ["score", "predicted", "lines", "bad_lines"])

    return score


def scored(docs: DataFrame, field: Field, text: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 if at least ``least``), lines and bad_lines; such columns are
    replaced. The score is the lines' probabilities of being good, weighted by their lengths. Null and empty texts, and
    those of blanks alone, count as one line without features. Rows don't move; a task holds 500 texts' features."""
    docs = docs.drop("score", "predicted", "lines", "bad_lines")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = docs.select(*docs.columns).schema.add("score", "double").add("predicted", "integer").add("lines", "long").add("bad_lines", "long")
    return docs.select(F.col(text).cast("binary").alias("__text"), *docs.columns).mapInArrow(_score(shared, least), schema)
