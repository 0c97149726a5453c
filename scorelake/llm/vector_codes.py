"""Codes of vectors by a codebook for each part, with the nearest entry found by Orchard's search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.common import written
from scorelake.llm.vectors import finite, matrix

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are searched for together.
TOGETHER = 4096
#: Labels with more than this share of all rows, one in so many, are joined by broadcast: there can't be more of them.
HOT = 10_000


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as Python's whole numbers where 64 bits don't do for squared distances."""
    width = max(1, x.shape[1] if x.ndim > 1 else 1)
    if not x.size or np.abs(x).max() * SCALE < math.isqrt((1 << 60) // width) // 4:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) > 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


class Orchard:
    """Nearest entries of a codebook. Each entry has a list of all entries, sorted by their distance from it.

    A search holds one entry and goes along its list. A nearer entry (or an equal one with a lower index) takes its
    place, and the search goes on along that one's list; entries that were met are marked and not measured again. By
    the triangle inequality no entry can be nearer or equal from where the list's distance is beyond twice the
    distance now, and the search ends. Distances are squared whole numbers, so twice is four times and all is exact."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        apart = np.stack([squared(book, e) for e in book])
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``x``, searched together, each from its ``start``."""
        best, entries = start.astype(np.int64), len(self.book)
        distance = squared(x, self.book[best])
        at, seen = np.zeros(len(x), np.int64), np.zeros((len(x), entries), bool)
        seen[np.arange(len(x)), best] = True
        going = np.arange(len(x))
        while len(going):
            here = best[going]
            ends = at[going] >= entries
            ends |= self.apart[here, np.minimum(at[going], entries - 1)] > 4 * distance[going]
            going, here = going[~ends], here[~ends]
            entry = self.lists[here, at[going]]
            at[going] += 1
            new = ~seen[going, entry]
            rows, entry = going[new], entry[new]
            seen[rows, entry] = True
            d = squared(x[rows], self.book[entry])
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (entry < best[rows]))
            rows = rows[nearer]
            best[rows], distance[rows], at[rows] = entry[nearer], d[nearer], 0
        return best, distance


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def assigned(parts: list[np.ndarray], trees: list[Orchard]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and distances of the rows, part by part; all searches begin at entry 0."""
    for part, tree in zip(parts, trees):
        found = [tree.nearest(part[a : a + TOGETHER], np.zeros(len(part[a : a + TOGETHER]), np.int64)) for a in range(0, len(part), TOGETHER)]
        yield tuple(map(np.concatenate, zip(*found)))


def _sums(shared, width: int, parts: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, entry, place, n, total): what the task's rows add to each entry."""
        books = shared.value
        trees = [Orchard(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in filter(len, batches):
            cut = split(whole(matrix(batch.column(0), width)), parts)
            for k, (part, (code, _)) in enumerate(zip(cut, assigned(cut, trees))):
                found = np.zeros(books[k].shape, part.dtype)
                np.add.at(found, code, part)
                total[k] += found
                n[k] += np.bincount(code, minlength=len(n[k]))
        for k, book in enumerate(books):
            entry, place = (i.ravel() for i in np.indices(book.shape))
            used = n[k][entry] > 0
            columns = [np.full(int(used.sum()), k), entry[used], place[used], n[k][entry][used]]
            texts = [str(v) for v in total[k].ravel()[used]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.string())], names=["part", "entry", "place", "n", "total"])

    return sums


def _coded(shared, width: int, parts: int):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Orchard(b) for b in shared.value if len(b)]
        for batch in filter(len, batches):
            found = list(assigned(split(whole(matrix(batch.column(0), width)), parts), trees))
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*(code.tolist() for code, _ in found))]
            errors = [int(sum(row)) for row in zip(*(d.tolist() for _, d in found))]
            errors = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(codes, pa.string()), errors], names=["vec_id", "label", "code", "error"])

    return coded


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the ``entries`` smallest ids; null ids come last, equal ids by their vector."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    return split(whole(matrix(first.column(0), width)), parts)


def trained(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: each entry becomes the componentwise floor of the mean of its rows' parts; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = "part long, entry long, place long, n long, total string"
    sums = rows.select("vector").mapInArrow(_sums(shared, width, len(books)), kinds)
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.astype(object) for b in books]
    for r in sums.toLocalIterator():
        out[r.part][r.entry, r.place] = int(r.total) // r.n
    shared.unpersist()
    return [narrowed(b) for b in out]


def narrowed(book: np.ndarray) -> np.ndarray:
    """In 64 bits, where these do for squared distances."""
    return book.astype(np.int64) if max((abs(v) for v in book.ravel().tolist()), default=0) < math.isqrt((1 << 60) // max(1, book.shape[1])) // 4 else book


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels. A label with a large share of all rows is joined by broadcast
    (there can be ``HOT`` such labels at most), so that the shuffled join of the others has no hot key."""
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot, cold = sums.where(F.col("n") > rows // HOT).drop("n"), sums.where(F.col("n") <= rows // HOT).drop("n")

    def joined(side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("label", "same")
        return codes.join(side, F.col("label").eqNullSafe(F.col("same"))).drop("same")

    return joined(F.broadcast(hot)).union(joined(cold))


def vector_codes(table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks): every vector as the numbers of its parts' nearest entries.

    Components become floor(1024 x), whole numbers of any size, and all that follows is exact. Each round is one pass:
    tasks add up their rows by entry, and what goes to the driver is ``entries`` x width sums, whatever the rows.
    Distances are squared, ties go to the lower index. The codebooks start as the rows of the smallest ids.

    Rows whose vector is null or holds a null or non-finite component are left out. Shorter vectors, and those that
    can't be cut evenly, are filled up with zeros. Null ids are coded as the others. Null labels count as equal. Rows
    that repeat count and are given each time. With fewer rows than entries, the codebooks are that short. An error
    beyond 64 bits is null; sums of an entry are meant up to 38 digits. An empty table gives an empty one and empty
    codebooks. Other columns are not read, whatever their names."""
    rows = table.select(F.col(id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(finite(F.col("vector")))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-width // parts)) * parts
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = trained(rows, books, width)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    codes = written(rows.select("vector", "vec_id", "label").mapInArrow(_coded(shared, width, parts), kinds), "codes")
    return label_errors(codes), books
