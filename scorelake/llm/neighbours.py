"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, a chi-square test to stop."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from scorelake.llm.common import written
from scorelake.llm.vectors import finite, matrix

#: Projected dimensions (an even number), and how surely a neighbour must have been met before a search stops.
DIMENSIONS, SURE = 8, 0.95
#: Rows of a leaf, rows of a block (in which a search holds all vectors), cells of the upper tree, sampled rows for it.
LEAF, BLOCK, CELLS, SAMPLE = 128, 65_536, 4096, 65_536
#: Queries that are searched for in one task, and together in one step.
QUERIES, TOGETHER = 16_384, 512
#: Rounding that two ways to add up a product may differ by, of the product of the norms.
CLOSE = 1e-10
NO_ID = np.iinfo(np.int64).max


def chi_square(p: float, m: int) -> float:
    """The value that a sum of ``m`` squared standard normals stays below with probability ``p``; ``m`` is even."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < p else (low, (low + high) / 2)
    return high


@dataclass
class Space:
    """The largest inner product as a least distance. Vectors are scaled so that the longest has length 1, and lifted
    by one component to length 1; of a query that component is 0. Then |q - x|^2 = |q|^2 + 1 - 2 qx. A projection is
    ``dimensions`` products with standard normal vectors; the squared distance of two projections is that of the
    vectors times a chi-square variable."""

    width: int
    longest: float
    dimensions: int = DIMENSIONS
    sure: float = SURE

    def __post_init__(self) -> None:
        self.normal = np.random.default_rng(1).standard_normal((self.width + 1, self.dimensions))
        self.stop = chi_square(self.sure, self.dimensions)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / self.longest

    def projected(self, scaled: np.ndarray, query: bool = False) -> np.ndarray:
        out = scaled @ self.normal[:-1]
        if not query:
            out += np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))[:, None] * self.normal[-1]
        return out


@dataclass
class Tree:
    """The upper levels of the kd-tree: a full binary tree of medians, found on the sampled rows."""

    axis: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, cells: int) -> Tree:
        inner = cells - 1
        axis, at, parts = np.zeros(inner, np.int64), np.zeros(inner), {0: points}
        for node in range(inner):
            p = parts.pop(node)
            if len(p):
                axis[node] = int(np.argmax(p.max(0) - p.min(0)))
                at[node] = np.median(p[:, axis[node]])
            right = p[:, axis[node]] > at[node]
            parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
        return cls(axis, at)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


def leaves(points: np.ndarray, size: int = LEAF) -> np.ndarray:
    """The number of the leaf of each point: halves at the median of the widest axis, down to ``size`` points."""
    leaf, parts, n = np.zeros(len(points), np.int64), [np.arange(len(points))], 0
    while parts:
        rows = parts.pop()
        if len(rows) <= size:
            leaf[rows] = n
            n += 1
            continue
        p = points[rows]
        axis, half = int(np.argmax(p.max(0) - p.min(0))), len(rows) // 2
        order = np.argpartition(p[:, axis], half)
        parts += [rows[order[half:]], rows[order[:half]]]
    return leaf


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k, None]
        out += np.maximum(0, np.maximum(low[None, :, k] - p, p - high[None, :, k])) ** 2
    return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last, so that equal vectors score equal."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += x[:, k] * y[:, k]
    return out


class Block:
    """The rows of one block as leaves of the kd-tree."""

    def __init__(self, space: Space, x: np.ndarray, id: np.ndarray, rid: np.ndarray, leaf: np.ndarray | None = None) -> None:
        self.space = space
        scaled = space.scaled(x)
        points = space.projected(scaled)
        leaf = leaves(points) if leaf is None else leaf
        self.order = order = np.argsort(leaf, kind="stable")
        self.x, self.scaled, self.id, self.rid, self.leaf = x[order], scaled[order], id[order], rid[order], leaf[order]
        self.starts = np.flatnonzero(np.diff(self.leaf, prepend=-1))
        self.ends = np.append(self.starts[1:], len(x))
        self.low, self.high = (f.reduceat(points[order], self.starts) for f in (np.minimum, np.maximum))

    def search(self, q: np.ndarray, rid: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the ``k`` best rows met for each query, none below ``least``.

        Each query takes the leaves in order of their projected distance, a few more each time. It stops when the next
        leaf is so far that, were there a row in it as near as the k-th best now, its projection would be nearer with
        probability ``sure``: projected distance^2 >= chi-square value * distance^2."""
        scaled = self.space.scaled(q)
        norm2 = (scaled * scaled).sum(1)
        gap = gaps(self.space.projected(scaled, True), self.low, self.high)
        order = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, order, 1)
        floor = least / self.space.longest / self.space.longest
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        at, going, step = 0, np.arange(len(q)), 1
        while len(going) and at < len(self.starts):
            reach = self.space.stop * np.maximum(0, norm2[going] + 1 - 2 * floor[going] + CLOSE)
            near = gap[going, at : at + step] <= reach[:, None]
            pair, which = np.nonzero(near)
            asked, leaf = going[pair], order[going[pair], at + which]
            found = [held]
            by_leaf = np.argsort(leaf, kind="stable")
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                if len(part):
                    rows, a, b = asked[part], self.starts[leaf[part[0]]], self.ends[leaf[part[0]]]
                    score = scaled[rows] @ self.scaled[a:b].T
                    i, j = np.nonzero(score >= (floor[rows] - CLOSE)[:, None])
                    i, j = rows[i], j + a
                    other = self.rid[j] != rid[i]
                    i, j = i[other], j[other]
                    score = product(q[i], self.x[j])
                    good = score >= least[i]
                    found.append((i[good], j[good], score[good]))
            i, j, score = (np.concatenate(c) for c in zip(*found))
            best = np.lexsort((self.id[j], -score, i))
            i, j, score = i[best], j[best], score[best]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            full = rank == k - 1
            floor[i[full]] = np.maximum(floor[i[full]], score[full] / self.space.longest / self.space.longest)
            keep = rank < k
            held = (i[keep], j[keep], score[keep])
            going = going[near[:, -1]] if near.shape[1] else going[:0]
            at, step = at + step, step * 2
        return held


def searched(block: Block, q: np.ndarray, rid: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for a in range(0, len(q), TOGETHER):
        i, j, score = block.search(q[a : a + TOGETHER], rid[a : a + TOGETHER], least[a : a + TOGETHER], k)
        yield i + a, j, score


def numbers(column: pa.ChunkedArray, none: int | float) -> np.ndarray:
    return column.fill_null(none).to_numpy()


def _cells(shared):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, axis, n, low, high) of the rows of a task."""
        space, tree = shared.value
        size = len(tree.axis) + 1
        n, low, high = np.zeros(size, np.int64), np.full((size, space.dimensions), np.inf), np.full((size, space.dimensions), -np.inf)
        for batch in batches:
            points = space.projected(space.scaled(matrix(batch.column(0), space.width)))
            cell = tree.cell(points)
            n += np.bincount(cell, minlength=size)
            np.minimum.at(low, cell, points)
            np.maximum.at(high, cell, points)
        used, axis = np.nonzero(np.isfinite(low))
        columns = [used, axis, n[used], low[used, axis], high[used, axis]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "axis", "n", "low", "high"])

    return cells


def _dealt(shared):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the block of each: its cell, or a portion of a cell of many rows."""
        space, tree, first, portions = shared.value
        for batch in batches:
            cell = tree.cell(space.projected(space.scaled(matrix(batch.column(2), space.width))))
            rid = batch.column(0).to_numpy()
            salt = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first[cell] + (salt % portions[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "block"])

    return dealt


def _built(shared, k: int, every: int):
    def built(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows in order of their leaves. Of those that are queries, what the k-th best of the block scores:
        the best k of all score no less."""
        space = shared.value[0]
        table = pa.Table.from_batches(groups)
        x, id = matrix(table["vector"], space.width), numbers(table["vec_id"], NO_ID)
        block = Block(space, x, id, table["rid"].to_numpy())
        least = np.full(len(x), -np.inf)
        asked = np.flatnonzero((block.id % every == 0) & (block.id != NO_ID))
        for i, _, score in searched(block, block.x[asked], block.rid[asked], np.full(len(asked), -np.inf), k):
            last = np.append(i[1:], -1) != i
            enough = np.bincount(i, minlength=len(asked))[i] >= k
            least[asked[i[last & enough]]] = score[last & enough]
        table = table.take(pa.array(block.order)).append_column("leaf", pa.array(block.leaf)).append_column("least", pa.array(least, mask=~np.isfinite(least)))
        yield from table.select(INDEX).to_batches()

    return built


INDEX = ["block", "leaf", "rid", "vec_id", "vector", "least"]


def _routed(shared):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries, once for each block in which the test allows a neighbour."""
        space, _, first, portions, low, high = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                scaled = space.scaled(matrix(part.column(2), space.width))
                floor = part.column(3).fill_null(-np.inf).to_numpy() / space.longest / space.longest
                reach = space.stop * np.maximum(0, (scaled * scaled).sum(1) + 1 - 2 * floor + CLOSE)
                row, cell = np.nonzero(gaps(space.projected(scaled, True), low, high) <= reach[:, None])
                times = portions[cell]
                block = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out = part.take(pa.array(np.repeat(row, times)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block)], names=[*out.schema.names, "block"])

    return routed


def _found(shared, k: int):
    def found(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value[0]
        table = pa.Table.from_batches(groups)
        asked = table["leaf"].is_null()
        rows, queries = table.filter(pc.invert(asked)), table.filter(asked)
        names = ["query", "query_id", "vec_id", "score"]
        if not (rows.num_rows and queries.num_rows):
            return
        block = Block(space, matrix(rows["vector"], space.width), numbers(rows["vec_id"], NO_ID), rows["rid"].to_numpy(), rows["leaf"].to_numpy())
        rid, id = queries["rid"].to_numpy(), queries["vec_id"].to_numpy()
        for i, j, score in searched(block, matrix(queries["vector"], space.width), rid, numbers(queries["least"], -np.inf), k):
            columns = [pa.array(rid[i]), pa.array(id[i]), pa.array(block.id[j], mask=block.id[j] == NO_ID), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found


def nearest(table: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, sure: float = SURE, block_rows: int = BLOCK, sample: int = SAMPLE, together: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query, a row whose id is
    divisible by ``every``. Every other row is a candidate.

    1. Rows are projected to ``dimensions`` normal directions. The upper levels of a kd-tree are medians of a sample of
       about ``sample`` rows; every row is then put into its cell. Cells of more than ``block_rows`` rows are
       dealt to several blocks, so copies of one vector don't meet in one task. In its block a row belongs to a
       leaf of the lower levels. The index is a written table.
    2. A query is searched for in its own block first. What its k-th best scores there bounds the cells
       that it goes to: those nearer, in projection, than the chi-square test allows.
    3. There the leaves are visited in order of projected distance, rows are verified on the original vectors, and the
       search stops by the same test. The k best of all blocks are kept.

    ``sure`` is the probability to have met a neighbour that is as near as the k-th; nearer ones are met more surely.
    Scores are inner products in double precision, added up from the first component to the last; ties go to the
    smaller id, then null ids. Vectors that are null, zero, or hold null or non-finite components take no part; shorter
    ones are filled up with zeros. Rows that repeat an id are queries and candidates each; null ids are candidates
    only. With fewer than k other rows, all are given. An empty table gives an empty one. Other columns are not read,
    whatever their names."""
    spark = table.sparkSession
    kind = table.schema[vector].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("vector") if plain else F.col("vector").cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.select("rid", "vec_id", v.alias("vector")).where(finite(F.col("vector")))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    rows = rows.where(largest > 0)
    norm = largest * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x.cast("double") / largest) ** 2))
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
    out = "query long, query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(width, longest, dimensions, sure)
    block_rows = max(16, min(block_rows, max(1024, n // 16), (1 << 26) // (8 * width)))
    cells = min(CELLS, 1 << (-(-n // block_rows) - 1).bit_length())
    taken = rows.where(F.rand(1) < sample / n).select("vector").toArrow()
    tree = Tree.of(space.projected(space.scaled(matrix(taken.column(0), width))), cells)

    shared = spark.sparkContext.broadcast((space, tree))
    boxes = rows.select("vector").mapInArrow(_cells(shared), "cell long, axis long, n long, low double, high double")
    boxes = boxes.groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    counts, low, high = np.zeros(cells, np.int64), np.full((cells, dimensions), np.inf), np.full((cells, dimensions), -np.inf)
    counts[boxes["cell"]] = boxes["n"]
    low[boxes["cell"], boxes["axis"]], high[boxes["cell"], boxes["axis"]] = boxes["low"], boxes["high"]
    portions = np.where(counts > 0, np.maximum(1, np.rint(counts / block_rows)), 0).astype(np.int64)
    first = np.cumsum(portions) - portions
    portions_or_one = np.maximum(portions, 1)

    shared = spark.sparkContext.broadcast((space, tree, first, portions_or_one))
    dealt = rows.mapInArrow(_dealt(shared), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, block long")
    kinds = f"block long, leaf long, rid long, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, least double"
    index = written(dealt.groupBy("block").applyInArrow(_built(shared, k, every), kinds), "index")

    shared = spark.sparkContext.broadcast((space, tree, first, portions, low, high))
    asked = index.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "vector", "least")
    routed = asked.mapInArrow(_routed(shared), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in asked.schema)}, block long")
    loads = written(routed.groupBy("block").agg((F.count("*") / together).cast("int").alias("more")), "loads")
    routed = routed.join(loads, "block").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("more") + 1).cast("int"))
    copies = index.join(loads, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("more"))))
    columns = ["block", "chunk", "leaf", "rid", "vec_id", "vector", "least"]
    both = copies.select(columns).union(routed.withColumn("leaf", F.lit(None).cast("long")).select(columns))
    found = both.groupBy("block", "chunk").applyInArrow(_found(shared, k), out)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return found.where(F.col("rank") <= k)
