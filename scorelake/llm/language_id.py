"""Language identification by error-correcting output codes over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

GRAMS = 1 << 16
#: Documents of a language that are learned from at most (in expectation), chosen by a hash of the id.
SAMPLE = 50_000
#: Languages at most; each adds a row of ``GRAMS`` counts (512 KB) to what the driver gathers once.
LANGUAGES = 256
#: Bytes of text that are worked on at once.
SLICE = 2_000_000
#: ASCII letters to lower case, bytes of other letters as they are, all else to a space.
LETTERS = np.array([c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the whole text, a slice at a time."""
    text = b" " + text + b" "
    for at in range(0, len(text) - 2, SLICE):
        c = LETTERS[np.frombuffer(text, np.uint8, min(SLICE + 2, len(text) - at), at)]
        code = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        yield (code ^ code >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def profile(text: bytes) -> np.ndarray:
    """Share of each trigram; trigrams of blanks alone don't count."""
    n = sum((np.bincount(g, minlength=GRAMS) for g in grams(text)), np.zeros(GRAMS, np.int64))
    n[BLANK] = 0
    return n / max(1, n.sum())


BLANK = int(next(grams(b" "))[0])


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 per language. Up to five languages have the exhaustive code; more have the best of some random
    dense codes, by the least distance between two rows."""
    if languages <= 5:
        bits = np.arange(1, max(2, 2 ** (languages - 1)))
        return np.array([[1 if row == 0 else 1 - 2 * (b >> row - 1 & 1) for b in bits] for row in range(languages)], float)
    rng, width, best = np.random.default_rng(seed), int(np.ceil(12 * np.log2(languages))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code = code[:, np.abs(code.sum(0)) < languages]
        gram = code @ code.T - 2 * code.shape[1] * np.eye(languages)
        if best is None or gram.max() < best[0]:
            best = (gram.max(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  #: language x bit
    weights: np.ndarray  #: trigram x bit
    power: np.ndarray  #: of each bit: how far apart its two sides lie
    bias: np.ndarray

    def losses(self, shares: np.ndarray) -> np.ndarray:
        """Documents' loss for each language: each bit's logistic loss, weighted by the bit's power."""
        margin = (shares @ self.weights - self.bias) / np.maximum(self.power, 1e-9) * 6
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        return (loss * (self.power / self.power.sum())).sum(2) if self.power.sum() else loss.mean(2)


def _counts():
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (p := profile(text.as_py())).any():
                    held[lang] = held.get(lang, 0) + p
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "gram", "n"])

    return counts


def fitted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A binary classifier per bit of the code: log ratios of the trigram shares on the bit's two sides, the languages
    of a side counting alike. Rows without text or language are left out. About ``sample`` documents of each language
    are read, those with the least hashes of the id; their shares are summed up by Spark."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().limit(LANGUAGES + 1).collect()}
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(known)
    few = [(k, sample / n) for k, n in known.items() if n > sample]
    part = (F.xxhash64(F.lit("language"), F.col(id)).cast("double") / 2.0**64) + 0.5
    for k, share in few:
        rows = rows.where((F.col(lang) != k) | (part < share))
    sums = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    sums = sums.mapInArrow(_counts(), "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum(F.round(F.col("n") * 1e12).cast("long")).alias("n"))
    total = np.zeros((len(languages), GRAMS))
    found = sums.toPandas()
    total[found["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int), found["gram"]] = found["n"] / 1e12
    share = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
    code = codewords(len(languages)) if languages else np.ones((0, 1))
    share = share * 0.999 + 0.001 / GRAMS
    weights, power, bias = np.zeros((GRAMS, code.shape[1])), np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        if not (code[:, b] == 1).any() or not (code[:, b] == -1).any():
            continue
        yes, no = share[code[:, b] == 1].mean(0), share[code[:, b] == -1].mean(0)
        weights[:, b] = np.log(yes / no)
        mean = share @ weights[:, b]
        low, high = mean[code[:, b] == 1].min(), mean[code[:, b] == -1].max()
        bias[b], power[b] = (low + high) / 2, max(low - high, 1e-6)
    return Model(languages, code, weights.astype(np.float32), power, bias)


def _predict(shared, margin: float, at: int, first: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, doubt = ["und"] * n, [0.0] * n, [True] * n
            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                if not model.languages or text is None or not any(map(str.isalpha, text)):
                    continue
                total, count = np.zeros(model.weights.shape[1]), 0
                for g in grams(text.encode()):
                    g = g[g != BLANK]
                    total += model.weights[g].sum(0, dtype=np.float64)
                    count += len(g)
                margin_ = (total / max(count, 1) - model.bias) / np.maximum(model.power, 1e-9) * 6
                loss = (np.logaddexp(0, -margin_ * model.code) * (model.power / max(model.power.sum(), 1e-9))).sum(1)
                p = np.exp(-4 * (loss - loss.min()))
                p /= p.sum()
                best = int(p.argmax())
                pred[i], score[i] = model.languages[best], float(p[best])
                doubt[i] = bool(len(p) > 1 and p[best] - np.partition(p, -2)[-2] < margin)
            columns = batch.columns[first:] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(doubt)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[first:] + ["lang_pred", "score", "ambiguous"])

    return predict


def identified(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.05) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous; columns of these names are replaced.

    The text alone decides: its margins on the code's bits, and the codeword with the least weighted loss. ``und``
    (score 0, ambiguous) if the text is null or has no letter, or no language was learned. ``ambiguous``: the two best
    codewords' scores lie within ``margin``. Ties go to the first language by code point. Rows never move."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*docs.columns).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    if text in docs.columns:  # one column of texts on the way, not two
        return docs.mapInArrow(_predict(shared, margin, docs.columns.index(text), 0), schema)
    return docs.select(F.col(text).alias("__text"), *docs.columns).mapInArrow(_predict(shared, margin, 0, 1), schema)


def rejected() -> Column:
    """No language at all, or two that can't be told apart."""
    return (F.col("lang_pred") == "und") | F.col("ambiguous")
