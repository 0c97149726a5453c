"""Language-model scores: an interpolated modified Kneser-Ney bigram model in sorted hash arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.common import shared_folder
from scorelake.llm.near_dup import mixed_bits

#: Words are known by this many bits of their hash, pairs of words by 64.
ID = np.uint64(2**48 - 1)
START, END = np.uint64(1), np.uint64(2)
#: Bytes of text to a shard of the model, about.
SHARD_BYTES = 12_000_000
#: Word pairs that a task counts before it passes them on.
HELD = 4_000_000
#: Bytes of text that are scored at once.
SLICE = 2_000_000


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, A-Z lower-cased, as hashes one after the other, each text ended by END; and their numbers."""
    split = [t.lower().split() for t in texts]
    flat = np.empty(sum(map(len, split)), object)
    flat[:] = [w for words in split for w in words]
    n = np.array([len(words) for words in split], np.int64)
    out = np.full(len(flat) + len(n), END)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n + 1) - 1] = False
    out[inner] = np.maximum(pd.util.hash_array(flat, categorize=False) & ID, np.uint64(3))
    return out, n + 1


def before(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.roll(words, 1)
    out[np.cumsum(n) - n] = START
    return out


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (mixed_bits(words) >> np.uint64(20)) % np.uint64(shards)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed_bits(context * np.uint64(0x9E3779B97F4A7C15) + mixed_bits(word))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths) // size
    starts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(column)]
    return ((a, b) for a, b in zip(starts, starts[1:]) if b > a)


def packed(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], *(np.add.reduceat(v[order].astype(np.int64), starts) if len(keys) else v.astype(np.int64) for v in values)


def _pairs(shards: int):
    """Blocks (shard of the word; its contexts and words in 48 bits each, and counts), counted within the task."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give() -> pa.RecordBatch:
            names, pay = [], []
            if held:
                w, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.lexsort((v, w))
                w, v = w[order], v[order]
                starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
                c = np.diff(np.r_[starts, len(w)]).astype("<u4")
                w, v = w[starts], v[starts]
                to = shard_of(w, shards)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(to[order].astype(np.int64)) != 0])
                for at in np.split(order, cuts[1:]):
                    first = np.flatnonzero(np.r_[True, w[at][1:] != w[at][:-1]])
                    x = v[at]
                    names.append(int(to[at[0]]))
                    pay.append(packed(w[at][first].astype("<u8"), np.diff(np.r_[first, len(at)]).astype("<u4")) + packed(x.astype("<u4"), (x >> np.uint64(32)).astype("<u2"), c[at]))
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(pay, pa.binary())], names=["shard", "block"])

        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                words, n = word_ids([t or b"" for t in batch.column(0)[a:b].to_pylist()])
                held.append((words, before(words, n)))
                size += len(words)
                if size > HELD:
                    yield give()
                    size = 0
        yield give()

    return pairs


def _put(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Each array as a file that is there as a whole or not at all, also if another attempt writes it too."""
    for key, values in columns.items():
        own = f"{folder}/.{uuid.uuid4().hex}"
        np.save(f"{own}.npy", values)
        os.replace(f"{own}.npy", f"{folder}/{name}-{key}.npy")


def _merge(folder: str, shards: int):
    """A shard of words: stores their pairs, counts and numbers of contexts; gives (kind 0) what its pairs add to each
    context, by the context's shard, and (kind 1) how many pairs and words have counts of 1 to 4, and totals."""

    def merge(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in blocks:
            for block in batch.column("block"):
                data = block.as_py()
                w, n = unpacked(data, ["<u8", "<u4"])
                low, high, c = unpacked(data[8 + 12 * len(w) :], ["<u4", "<u2", "<u4"])
                parts.append((np.repeat(w, n), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), c))
        w, v, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((v, w))
        w, v, c = w[order], v[order], c[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
        w, v, c = w[starts], v[starts], np.add.reduceat(c, starts)
        shard = key[0].as_py()
        h = pair_hash(v, w)
        order = np.argsort(h)
        h, many = h[order], c[order]
        big = many >= 255
        _put(folder, f"pairs-{shard}", {"hash": h, "count": np.minimum(many, 255).astype(np.uint8), "bighash": h[big], "big": many[big]})
        words, tokens, contexts = summed(w, c, np.ones(len(w)))
        _put(folder, f"words-{shard}", {"hash": words, "tokens": tokens.astype("<i8"), "contexts": contexts.astype("<u4")})
        sizes = lambda x: [int((x == k).sum()) for k in (1, 2, 3, 4)]
        kind, to, pay = [1], [0], [packed(np.array([*sizes(c), *sizes(contexts), len(words), int(tokens.sum()), len(c)], "<i8"))]
        vs, total, n1, n2, n3 = summed(v, c, c == 1, c == 2, c > 2)
        home = shard_of(vs, shards)
        order = np.argsort(home, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(home[order].astype(np.int64))) + 1):
            kind.append(0)
            to.append(int(home[at[0]]))
            pay.append(packed(vs[at].astype("<u4"), (vs[at] >> np.uint64(32)).astype("<u2"), *(x[at].astype("<u4") for x in (n1, n2, n3)), total[at].astype("<i8")))
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(to, pa.int64()), pa.array(pay, pa.binary())], names=["kind", "shard", "block"])

    return merge


def _contexts(folder: str):
    def contexts(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stores a shard of contexts: counts, and how many words follow once, twice, more; or passes totals on."""
        kind, shard = key[0].as_py(), key[1].as_py()
        data = [b.as_py() for batch in blocks for b in batch.column("block")]
        if kind == 1:
            total = sum(unpacked(d, ["<i8"])[0] for d in data)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["totals"])
            return
        parts = [unpacked(d, ["<u4", "<u2", "<u4", "<u4", "<u4", "<i8"]) for d in data]
        low, high, *values = (np.concatenate(x) for x in zip(*parts))
        v, n1, n2, n3, total = summed(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), *values)
        _put(folder, f"contexts-{shard}", {"hash": v, "n1": n1.astype("<u4"), "n2": n2.astype("<u4"), "n3": n3.astype("<u4"), "tokens": total})

    return contexts


@dataclass
class Model:
    """Where the arrays are, and the numbers that all probabilities share."""

    folder: str
    shards: int
    tokens: int = 0
    vocabulary: int = 0
    pairs: int = 0
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    word_rest: float = 1.0
    arrays: dict = field(default_factory=dict)

    def array(self, name: str) -> np.ndarray | None:
        """Memory-mapped; the pages that are used are shared by all workers of a machine."""
        if name not in self.arrays:
            path = f"{self.folder}/{name}.npy"
            self.arrays[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.arrays[name]

    def look_up(self, table: str, keys: np.ndarray, shard: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """Values of sorted distinct or any keys, 0 where a key isn't stored."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.lexsort((keys, shard))
        for at in np.split(order, np.flatnonzero(np.diff(shard[order].astype(np.int64))) + 1) if len(keys) else []:
            name = f"{table}-{shard[at[0]]}"
            stored = self.array(f"{name}-hash")
            if stored is None or not len(stored):
                continue
            place = np.minimum(np.searchsorted(stored, keys[at]), len(stored) - 1)
            there = stored[place] == keys[at]
            for values, c in zip(out, columns):
                values[at[there]] = self.array(f"{name}-{c}")[place[there]]
            if table == "pairs" and (more := there & (out[0][at] == 255)).any():
                big = np.searchsorted(self.array(f"{name}-bighash"), keys[at[more]])
                out[0][at[more]] = self.array(f"{name}-big")[big]
        return out

    def log_probabilities(self, words: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each word after its context, the word's count)."""
        kinds, at = np.unique(words, return_inverse=True)
        tokens, contexts = self.look_up("words", kinds, shard_of(kinds, self.shards), ["tokens", "contexts"])
        low = (contexts - discount(contexts, self.word_discounts)) / max(1, self.pairs) + self.word_rest / (self.vocabulary + 1)
        vs, of = np.unique(context, return_inverse=True)
        total, n1, n2, n3 = self.look_up("contexts", vs, shard_of(vs, self.shards), ["tokens", "n1", "n2", "n3"])
        d = self.pair_discounts
        rest = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
        h, which, back = np.unique(pair_hash(context, words), return_index=True, return_inverse=True)
        (count,) = self.look_up("pairs", h, shard_of(words[which], self.shards), ["count"])
        count = count[back]
        high = (count - discount(count, d)) / np.maximum(total[of], 1)
        return np.log10(high + rest[of] * low[at]), tokens[at]


def discount(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.where(counts > 0, np.array(d)[np.clip(counts, 1, 3) - 1], 0.0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of counts 1 to 4; half a count where these don't give one."""
    if min(n[:3]) == 0:
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05, k + 0.95)) for k in range(3))


def trained(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts word pairs of all ``docs`` in Spark and stores the model in the shared folder, which must be mounted on
    every machine, as workers map its files.

    Tasks count before they pass pairs on, so that a common word or pair is one entry per task; shards are of hashed
    words, as many as the text asks for. No count reaches the driver but eleven totals. Null texts are empty: an end."""
    spark = docs.sparkSession
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("the shared folder must be mounted: the model's files are mapped into memory")
    folder = f"{where.path}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = docs.select(F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << min(16, max(2, int(size / shard_bytes).bit_length()))
    blocks = rows.mapInArrow(_pairs(shards), "shard long, block binary").groupBy("shard").applyInArrow(_merge(folder, shards), "kind long, shard long, block binary")
    done = blocks.groupBy("kind", "shard").applyInArrow(_contexts(folder), "totals array<long>").collect()
    model = Model(folder, shards)
    if done:
        t = done[0]["totals"]
        model.pair_discounts, model.word_discounts = discounts(t[:4]), discounts(t[4:8])
        model.vocabulary, model.tokens, model.pairs = t[8:]
        d, more = model.word_discounts, t[8] - t[4] - t[5]
        model.word_rest = (d[0] * t[4] + d[1] * t[5] + d[2] * more) / max(1, model.pairs)
    return model


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        base = lambda c: np.log10((c + 1) / (model.tokens + model.vocabulary + 1))
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                some = batch.slice(a, b - a)
                words, n = word_ids([t or b"" for t in some.column(0).to_pylist()])
                logs, counts = model.log_probabilities(words, before(words, n))
                starts = np.cumsum(n) - n
                sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base(counts.astype(float)), logs)]
                columns = [pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** np.minimum(-sums[2] / n, 300))]
                yield pa.RecordBatch.from_arrays(some.columns[1:] + columns, names=batch.schema.names[1:] + NAMES)

    return score


NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score (log10 probability) and perplexity; such columns
    are replaced. Tokens: the words, A-Z lower-cased, and an end. Null and empty texts have the end alone. A word that
    was not learned has the probability that the model leaves to all such words; of a model of nothing, all are alike.
    Rows don't move."""
    docs = docs.drop(*NAMES)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*docs.columns).schema
    for name, kind in zip(NAMES, ["long"] * 3 + ["double"] * 3):
        schema = schema.add(name, kind)
    return docs.select(F.col(text).cast("binary").alias("__text"), *docs.columns).mapInArrow(_score(shared), schema)
