"""Greedy packing and pairing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ordered import CHUNK, by_rows, cut_columns, following, latest, previous, running_sum, scan, upcoming
from scorelake.session import checkpoint_folder


def consecutive_pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    link: Callable[[Column], Column],
) -> DataFrame:
    """Pairs neighbours left to right; a paired item is used up. In a run of links the first,
    third, ... are taken, so a running count replaces the loop."""
    step = scan(df, keys, order, {"_next": following(F.struct(order, *cols))}, keep=True)
    step = step.withColumn("_link", F.coalesce(link(F.col("_next")), F.lit(False)))
    step = scan(step, keys, order, {"_before": previous(F.col("_link"))}, keep=True)
    opens = F.col("_link") & ~F.coalesce("_before", F.lit(False))
    step = scan(
        step.withColumn("_one", F.col("_link").cast("long")), keys, order,
        {"_count": running_sum(F.col("_one"))}, keep=True,
    ).withColumn("_base", F.when(opens, F.col("_count")))
    step = scan(step, keys, order, {"_zero": latest(F.col("_base"))})
    return step.where(F.col("_link") & ((F.col("_count") - F.col("_zero")) % 2 == 0)).select(
        *keys, F.col(order).alias(f"first_{order}"), F.col("_next")[order].alias(f"second_{order}")
    )


def packed_lines(df: DataFrame, keys: Sequence[str], cuts: str, width: int) -> DataFrame:
    """Lines ``[a, b)`` no wider than ``width`` made of the stretches between sorted cuts; a
    wider stretch gets its own line. ``cuts`` is an array of distinct pixel positions."""
    start = F.struct(
        F.get(cuts, F.lit(0)).alias("a"), F.get(cuts, F.lit(0)).alias("b"),
        F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"),
    )

    def step(acc: Column, cut: Column) -> Column:
        full = (cut - acc["a"] > width) & (acc["b"] > acc["a"])
        line = F.struct(acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            F.when(full, acc["b"]).otherwise(acc["a"]).alias("a"), cut.alias("b"),
            F.when(full, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"),
        )

    done = lambda acc: F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))
    lines = df.select(*keys, F.aggregate(cuts, start, step, done).alias("_l"))
    return lines.select(*keys, F.explode_outer("_l").alias("l")).select(*keys, "l.a", "l.b")


def suppressed(df: DataFrame, keys: Sequence[str], near: int) -> DataFrame:
    """Keeps a detection when no kept one of higher confidence (the lower ``x`` on a tie) lies
    closer than ``near``. Only the best one per pixel can stay, so a key holds at most one image
    width of candidates, folded as one array."""
    best = df.groupBy(*keys, "x").agg(F.max("conf").alias("conf"))
    ranked = best.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "x"))).alias("_r")
    )
    none = F.array().cast("array<struct<c:double,x:bigint>>")
    kept = F.aggregate(
        "_r",
        none,
        lambda acc, r: F.when(F.exists(acc, lambda k: F.abs(k["x"] - r["x"]) < near), acc).otherwise(
            F.array_append(acc, F.struct(r["c"].alias("c"), r["x"].alias("x")))
        ),
    )
    rows = ranked.select(*keys, kept.alias("_k")).select(*keys, F.explode_outer("_k").alias("k"))
    return rows.select(*keys, "k.x", (-F.col("k.c")).alias("conf"))


#: Items of a stretch that is followed in one task.
STRETCH = 1 << 16
NOWHERE = 1 << 62


class Stretches:
    """Many stretches of items, each in a row, as arrays: ``to`` is where a pointer leads in them, or ``out`` of them."""

    def __init__(self, pdf: pd.DataFrame, keys: list[str]):
        stretch = pdf.groupby([*keys, "_stretch"], sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["_n"].to_numpy(), stretch))
        self.rows, stretch = pdf.iloc[order], stretch[order]
        n, to = self.rows["_n"].to_numpy(), self.rows["_to"].to_numpy()
        starts = np.flatnonzero(np.diff(stretch, prepend=-1))
        sizes = np.diff(np.append(starts, len(n)))
        ahead = to - np.repeat(n[starts], sizes)
        self.inside = ahead < np.repeat(sizes, sizes)
        self.to = np.where(self.inside, np.repeat(starts, sizes) + ahead, -1)
        self.out = to

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the pages that begin at each item lead out of its stretch, and how many begin on the way. Pointers are
        doubled, so the steps are the logarithm of the pages."""
        to, out, pages, inside = self.to.copy(), self.out.copy(), np.ones(len(self.to), np.int64), self.inside.copy()
        while inside.any():
            ahead = to[inside]
            more, beyond, leads, on = pages[ahead], to[ahead], out[ahead], inside[ahead]
            pages[inside] += more
            out[inside], to[inside] = leads, beyond
            inside[inside] = on
        return out, pages

    def walked(self, at: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items that begin pages, and the pages, from the items where stretches are entered."""
        found, number = [at], [page]
        while len(at):
            on = self.inside[at]
            at, page = self.to[at[on]], page[on] + 1
            found.append(at)
            number.append(page)
        return np.concatenate(found), np.concatenate(number)


def packed_pages(df: DataFrame, keys: Sequence[str], order: str, size: str, height: int, gap: int, stretch: int | None = None) -> DataFrame:
    """(keys, order, page, at): items fill pages from the top. One that no longer fits, with a gap before all but the
    first of a page, opens the next page; one that is larger than a page has its own. Sizes are whole and not negative.

    A page that starts with an item ends where the running size passes its height: one ordered merge of ends and
    limits finds the start of the page after it, for every item. So pages are a walk along pointers. Stretches of items
    are each followed on their own, from the items that some earlier stretch points to; these few pointers are then
    doubled, as often as the logarithm of the stretches; and each stretch is walked once from where it is entered. No
    stretch waits for the one before it. ``order`` is unique in its key. Keys without items have no pages."""
    keys, stretch = list(keys), stretch or STRETCH
    checkpoint_folder(df.sparkSession)
    one = F.lit(1).cast("long")
    sized = df.select(*cut_columns(df), *keys, order, F.col(size).cast("long").alias("_size"))
    placed = scan(sized, keys, order, {"_n": running_sum(one, False), "_sum": running_sum(F.col("_size"), False)}, keep=True)
    placed = placed.withColumn("_top", F.col("_sum") + F.col("_n") * gap).drop("_sum").checkpoint()  # read four times
    ends = placed.select(*keys, (F.col("_top") + F.col("_size")).alias("_v"), F.lit(0).alias("_limit"), "_n")
    limits = placed.select(*keys, (F.col("_top") + height).alias("_v"), F.lit(1).alias("_limit"), "_n")
    after = scan(ends.union(limits), keys, ["_v", "_limit", "_n"], {"_to": upcoming(F.when(F.col("_limit") == 0, F.col("_n")))}, keep=True)
    to = F.coalesce(F.greatest("_to", F.when(F.col("_to").isNotNull(), F.col("_n") + 1)), F.lit(NOWHERE))
    links = after.where("_limit = 1").select(*cut_columns(after), *keys, "_n", to.alias("_to"), F.floor(F.col("_n") / stretch).alias("_stretch")).checkpoint()

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.select(*keys).schema)
    entered = links.where((F.col("_to") < NOWHERE) & (F.floor(F.col("_to") / stretch) > F.col("_stretch"))).select(*keys, F.col("_to").alias("_n")).distinct()
    spread, links = by_rows(links, [*keys, "_n"]).drop(*cut_columns(links)), links.drop(*cut_columns(links))
    entries = spread.join(entered.withColumn("_in", F.lit(True)), [*keys, "_n"], "left")

    def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(pdf, keys)
        out, pages = s.left()
        take = s.rows["_in"].notna().to_numpy() | (s.rows["_n"].to_numpy() == 0)
        return s.rows[[*keys, "_n"]].assign(_to=out, _pages=pages)[take]

    # many short stretches go to one call, as many calls as there are long ones
    calls = F.pmod(F.xxhash64(*keys, "_stretch"), F.lit(1 + links.count() // stretch))
    jumps = entries.groupBy(calls).applyInPandas(crossed, f"{key_types}, _n long, _to long, _pages long").where(f"_n = 0 or _to < {NOWHERE}").checkpoint()
    seen = jumps.where("_n = 0").select(*keys, "_n", F.lit(0).cast("long").alias("_page"))
    jumps = jumps.where(F.col("_to") < NOWHERE)
    while not jumps.isEmpty():
        at = seen.join(jumps, [*keys, "_n"]).select(*keys, F.col("_to").alias("_n"), (F.col("_page") + F.col("_pages")).alias("_page"))
        seen = seen.union(at).checkpoint()
        further = jumps.select(*keys, F.col("_n").alias("_to"), F.col("_to").alias("_next"), F.col("_pages").alias("_more"))
        jumps = jumps.join(further, [*keys, "_to"]).select(*keys, "_n", F.col("_next").alias("_to"), (F.col("_pages") + F.col("_more")).alias("_pages")).checkpoint()

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(pdf, keys)
        at = np.flatnonzero(s.rows["_page"].notna().to_numpy())
        found, page = s.walked(at, s.rows["_page"].to_numpy()[at].astype(np.int64))
        return s.rows[[*keys, "_n"]].iloc[found].assign(_page=page)

    starts = spread.join(seen, [*keys, "_n"], "left").groupBy(calls).applyInPandas(walked, f"{key_types}, _n long, _page long")
    opened = by_rows(placed, [*keys, "_n"]).join(starts, [*keys, "_n"], "left").withColumn("_first", F.when(F.col("_page").isNotNull(), F.struct("_page", "_top")))
    out = scan(by_rows(opened, [*keys, CHUNK]), keys, order, {"_on": latest(F.col("_first"))})
    return out.select(*keys, order, F.col("_on._page").alias("page"), (F.col("_top") - F.col("_on._top")).alias("at"))
