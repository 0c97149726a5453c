"""Source divergence audit: a k-squared quadtree over the counts of groups and terms, traversed for pairs of groups."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from scorelake.llm.common import written

#: Letters A-Z, a-z and everything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms that a task counts before it passes them on.
HELD = 400_000
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 22
#: Non-zero counts of a stripe of terms, about, and groups of a tile's side, about.
STRIPE_COUNTS, TILE_GROUPS = 8192, 256
#: Quadrants that are looked at together.
FRONT = 1 << 16


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between terms."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and TERM.match(text, end, end + 1):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): how often, and in how many documents, of those this task has seen."""
    n, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def give() -> pa.RecordBatch:
        keys = [(*group, term) for group, terms in n.items() for term in terms]
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([k[2] for k in keys], pa.binary()).cast(pa.string())]
        columns += [pa.array([c[k[:2]][k[2]] for k in keys], pa.int64()) for c in (n, docs)]
        n.clear(), docs.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            seen, terms = {}, n[lang, source]
            held -= len(terms)
            for part in slices(text.as_py().lower()):  # of bytes: A-Z only
                found = TERM.findall(part)
                terms.update(found)
                seen.update(dict.fromkeys(found))
            docs[lang, source].update(seen.keys())
            held += len(terms)
            if held > HELD:
                yield give()
                held = 0
    yield give()


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so nothing overflows."""
    return (p - q) * (p - q) // (p + q)


class Quadtree:
    """A matrix of ``rows`` x ``columns`` as levels of non-empty quadrants: level k has quadrants of 2^k x 2^k."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, zero: np.ndarray, columns: int) -> None:
        self.rows, self.columns, self.zero = len(zero), columns, zero
        self.height = max(len(zero) - 1, columns - 1, 0).bit_length()
        key = row.astype(np.int64) * columns + column
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.levels = []
        for k in range(self.height + 1):
            full = np.zeros((((len(zero) - 1) >> k) + 1, ((max(columns, 1) - 1) >> k) + 1), bool)
            full[row >> k, column >> k] = True
            self.levels.append(full)

    def at(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The values of single cells; an empty one has its row's zero value."""
        if not len(self.key):
            return self.zero[row]
        key = row * self.columns + column
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[found] == key, self.value[found], self.zero[row])

    def pairs(self, first: int, split: int) -> np.ndarray:
        """Sums of ``price`` over all columns for rows i in [0, ``first``) with rows j in [``split``, rows), i < j.

        A quadrant of rows I and one of rows J over the same columns are looked at together. If both are empty, all
        their cells are equal, and they are priced by their number; else they are cut into halves, down to cells."""
        i, j = np.meshgrid(np.arange(first), np.arange(split, self.rows), indexing="ij")
        total = np.zeros((self.rows, self.rows), np.int64)
        if not self.columns or not self.rows:
            return total
        empty = [np.zeros((len(full), len(full)), np.int64) for full in self.levels]
        front = [(self.height, np.zeros((1, 3), np.int64))]
        while front:
            k, nodes = front.pop()
            if len(nodes) > FRONT:
                front.append((k, nodes[FRONT:]))
                nodes = nodes[:FRONT]
            a, b, c = nodes.T
            inside = (a << k < first) & ((b + 1) << k > split) & (b << k < self.rows) & (c << k < self.columns)
            inside &= ((b + 1) << k) - 1 > a << k  # some j of it is greater than some i
            a, b, c = a[inside], b[inside], c[inside]
            full = self.levels[k]
            some = full[a, c] | full[b, c]
            za, zb, zc = a[~some], b[~some], c[~some]
            width = np.minimum((zc + 1) << k, self.columns) - (zc << k)
            np.add.at(empty[k], (za, zb), width)
            if k == 0:
                x, y, z = a[some], b[some], c[some]
                np.add.at(total, (x, y), price(self.at(x, z), self.at(y, z)))
                continue
            if some.any():
                halves = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], np.int64)
                front.append((k - 1, (2 * np.stack([a[some], b[some], c[some]], 1)[:, None, :] + halves).reshape(-1, 3)))
        cells = sum(e[i >> k, j >> k] for k, e in enumerate(empty))
        total[i, j] += cells * price(self.zero[i], self.zero[j])
        return total


def _tile(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, one, other, value, columns, empty, terms) of the pairs of groups of a tile: the sum over those terms of
    one stripe that some group of the tile has, the number of these, the price of an empty cell, and all kept terms."""
    table = pa.Table.from_batches(groups)
    lang, _, a, b = (k.as_py() for k in key)
    block, source = table["block"].to_numpy(), np.array(table["source"].to_pylist(), object)
    p, term = table["p"].to_numpy(), np.array(table["term"].to_pylist(), object)
    head = np.array([t is None for t in term], bool)
    order = np.lexsort((source[head], block[head] != a))
    names, zero = source[head][order], p[head][order]
    first = int((block[head] == a).sum())
    index = {s: i for i, s in enumerate(names)}
    row = np.array([index[s] for s in source[~head]], np.int64)
    _, column = np.unique(term[~head].astype(str), return_inverse=True) if (~head).any() else (None, np.empty(0, np.int64))
    columns = int(column.max()) + 1 if len(column) else 0
    # terms of the same groups side by side, so that empty quadrants are large
    least, most, held = np.full(columns, len(names)), np.zeros(columns, np.int64), np.bincount(column, minlength=columns)
    np.minimum.at(least, column, row)
    np.maximum.at(most, column, row)
    place = np.empty(columns, np.int64)
    place[np.lexsort((held, most, least))] = np.arange(columns)
    tree = Quadtree(row, place[column], p[~head], zero, columns)
    i, j = np.meshgrid(np.arange(first), np.arange(0 if a == b else first, len(names)), indexing="ij")
    keep = i < j
    i, j = i[keep], j[keep]
    total = tree.pairs(first, 0 if a == b else first)
    kept = int(table["terms"].to_numpy()[head].max())
    arrays = [pa.array([lang] * len(i), pa.string()), pa.array(names[i], pa.string()), pa.array(names[j], pa.string()), pa.array(total[i, j])]
    arrays += [pa.array(np.full(len(i), columns)), pa.array(price(zero[i], zero[j])), pa.array(np.full(len(i), kept))]
    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "one", "other", "value", "columns", "empty", "terms"])


def share(count: str, total: str) -> F.Column:
    """1 + floor(10^9 (count + 2) / (total + 2 V)), in whole numbers of any size."""
    wide = DecimalType(28, 0)
    up = F.lit(1_000_000_000).cast(DecimalType(10, 0)) * (F.col(count) + 2).cast(wide)
    return F.call_function("div", up, (F.col(total).cast(wide) + 2 * F.col("terms").cast(wide))).cast("long") + 1


def divergence(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text", stripe_counts: int = STRIPE_COUNTS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and by which terms.

    1. Tasks count terms and documents by (lang, source, term) before anything is shuffled; a language keeps the terms
       of ``least`` documents or more.
    2. The counts of a language make a matrix of groups and terms. It is cut into stripes of terms, by a hash, and into
       tiles of ``tile_groups`` x ``tile_groups`` groups, so that no task holds a whole language. Each tile is a
       quadtree: quadrants that are empty for both of two groups are priced by their number of cells, the other leaves
       are visited for all pairs together; terms that no group of a tile has are priced likewise. Sums over stripes give part ``pair``; each pair is worked out once.
    3. Part ``term`` compares a group with its language: the ``top`` terms that it has more of.

    Null texts, languages and sources count as ''. A language without kept terms has pairs of value 0, and no terms.
    Ties are in order of the item's UTF-8. Repeated rows count each time. An empty table gives an empty one. Columns
    other than the three are not read, whatever their names. The result has a row for each ordered pair of sources."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = rows.select("lang", "source", F.col("text").cast("binary").alias("text"))
    found = found.mapInArrow(_counting, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"in_docs": F.sum("docs").over(same), "in_lang": F.sum("n").over(same)}).where(F.col("in_docs") >= least)
    kept = written(kept.select("lang", "source", "term", "n", "in_lang"), "kept")
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("entries"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    sides = {"stripes": F.coalesce(F.floor(F.col("entries") / stripe_counts), F.lit(0)) + 1, "sides": F.floor(F.col("sources") / tile_groups) + 1}
    langs = langs.select("lang", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total")), *(c.cast("int").alias(n) for n, c in sides.items()))
    groups = groups.join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total", "stripes", "sides")
    groups = written(groups.withColumn("block", F.pmod(F.xxhash64("source"), "sides").cast("int")), "groups")
    counted = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("in_lang", "lang_total")})
    counted = written(counted.select("lang", "source", "term", "p", "q", "stripes", "sides", "block"), "shares")

    none = groups.withColumn("zero", F.lit(0)).withColumn("p", F.when(F.col("terms") > 0, share("zero", "total")).otherwise(F.lit(1).cast("long")))
    stripes = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe")
    heads = none.select("lang", "source", "block", "sides", "p", F.lit(None).cast("string").alias("term"), "terms", stripes)
    cells = counted.select("lang", "source", "block", "sides", "p", "term", F.lit(0).cast("long").alias("terms"), F.pmod(F.xxhash64("term"), "stripes").cast("int").alias("stripe"))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda x: F.struct(F.least(x, "block").alias("a"), F.greatest(x, "block").alias("b"))))
    cells = heads.unionByName(cells).withColumn("tile", tiles).select("lang", "stripe", "tile.a", "tile.b", "source", "block", "p", "term", "terms")
    pairs = cells.groupBy("lang", "stripe", "a", "b").applyInArrow(_tile, "lang string, one string, other string, value long, columns long, empty long, terms long")
    value = F.sum("value") + (F.max("terms") - F.sum("columns")) * F.max("empty")  # no group of the tile has the other terms
    pairs = pairs.groupBy("lang", "one", "other").agg(value.alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    diff = F.col("p") - F.col("q")
    terms = counted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", diff * diff, F.col("p") + F.col("q")).alias("value"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ordered).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= top))
