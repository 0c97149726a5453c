"""Grouping of ordered detections. What lies in one frame has at most as many distinct places as the image has pixels, so
those rules are aggregates over one array of a frame; what runs on over time is a fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.fold import Fold
from scorelake.operators.tracking import word_mismatch

c = F.col


class Columns(Fold):
    """A new column starts where a place lies more than ``tol`` beyond the first place of the
    column (not the last one). Gives each place the start of its column."""

    tol = 40

    def row(self, x):
        if self.s is None or x - self.s > self.tol:
            self.s = x
        return [(x, self.s)]


def in_order(df: DataFrame, keys: Sequence[str], *fields: Column | str) -> DataFrame:
    """(keys, at): the rows of a key as one sorted array of structs."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("at"))


# ----------------------------------------------------------------- beats


def middle(counts: Column) -> Column:
    """Median of the places of sorted ``(x, n)``: the mean of the two middle ones."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("sum"))

    def step(acc: Column, p: Column) -> Column:
        upto = acc["upto"] + p["n"]
        holds = lambda rank: F.when((rank >= acc["upto"]) & (rank < upto), p["x"] / 2.0).otherwise(0.0)
        return F.struct(upto.alias("upto"), (acc["sum"] + holds(F.floor((total - 1) / 2)) + holds(F.floor(total / 2))).alias("sum"))

    return F.aggregate(counts, start, step, lambda acc: acc["sum"])


COUNTS = "array<struct<x:bigint,n:bigint>>"


def beat_places(notes: DataFrame, keys: Sequence[str], x: str, tol: float) -> DataFrame:
    """(keys, places): beats of a frame, each as its sorted places with how many notes are there. A note joins the beat
    before it while it lies within ``tol`` of the median of that beat's notes."""
    counted = notes.groupBy(*keys, c(x).cast("long").alias("x")).agg(F.count("*").alias("n"))
    none = F.struct(F.array().cast(f"array<{COUNTS}>").alias("done"), F.array().cast(COUNTS).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joins = (F.size(acc["open"]) == 0) | (F.abs(p["x"] - middle(acc["open"])) <= tol)
        return F.struct(
            F.when(joins, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(joins, F.array_append(acc["open"], p)).otherwise(F.array(p)).alias("open"),
        )

    beats = F.aggregate("at", none, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    return in_order(counted, keys, "x", "n").select(*keys, F.explode(beats).alias("places"))


def placed_beats(notes: DataFrame, rests: DataFrame, keys: Sequence[str], x: str, tol: float) -> DataFrame:
    """(keys, x, notes, rest): beats of notes at the median of their places, and every rest as a beat of its own, which
    notes on both sides don't mind."""
    beats = beat_places(notes, keys, x, tol)
    size = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    beats = beats.select(*keys, middle(c("places")).alias("x"), size.alias("notes"), F.lit(False).alias("rest"))
    return beats.unionByName(rests.select(*keys, c(x).cast("double").alias("x"), F.lit(0).cast("long").alias("notes"), F.lit(True).alias("rest")))


# ----------------------------------------------------------------- text runs, staves


def text_runs(blobs: DataFrame, keys: Sequence[str], gap: float, share: float) -> DataFrame:
    """(keys, x, y, run_x, run_y): blobs ``(x, y, w, h)`` from left to right as runs of text, named by their first blob.

    Of the runs in reach, those that end at most ``gap`` before the blob and have ``share`` of the lower height in common
    with it, the one that was begun first takes it."""
    run = "struct<x:bigint,y:bigint,right:bigint,top:bigint,bottom:bigint>"
    found = "struct<x:bigint,y:bigint,run_x:bigint,run_y:bigint>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("runs"), F.array().cast(f"array<{found}>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        bottom = b["y"] + b["h"]
        shared = lambda r: F.least(r["bottom"], bottom) - F.greatest(r["top"], b["y"])
        near = lambda r: b["x"] - r["right"] <= gap
        fits = lambda r: near(r) & (shared(r) >= share * F.least(b["h"], r["bottom"] - r["top"]))
        at = F.array_position(F.transform(acc["runs"], fits), True)
        taken = F.when(at > 0, F.get(acc["runs"], (at - 1).cast("int")))
        own = F.struct(b["x"].alias("x"), b["y"].alias("y"), (b["x"] + b["w"]).alias("right"), b["y"].alias("top"), bottom.alias("bottom"))
        wider = F.struct(
            taken["x"].alias("x"), taken["y"].alias("y"), F.greatest(taken["right"], own["right"]).alias("right"),
            F.least(taken["top"], own["top"]).alias("top"), F.greatest(taken["bottom"], own["bottom"]).alias("bottom"),
        )
        runs = F.when(at > 0, F.transform(acc["runs"], lambda r, i: F.when(i == at - 1, wider).otherwise(r))).otherwise(F.array_append(acc["runs"], own))
        row = F.struct(b["x"].alias("x"), b["y"].alias("y"), F.coalesce(taken["x"], b["x"]).alias("run_x"), F.coalesce(taken["y"], b["y"]).alias("run_y"))
        # a run that this blob is out of reach of is so for all that follow
        return F.struct(F.filter(runs, near).alias("runs"), F.array_append(acc["out"], row).alias("out"))

    rows = in_order(blobs.select(*keys, *(c(n).cast("long").alias(n) for n in ("x", "y", "w", "h"))), keys, "x", "y", "w", "h")
    return rows.select(*keys, F.inline(F.aggregate("at", start, step, lambda acc: acc["out"])))


def even_groups(lines: DataFrame, keys: Sequence[str], y: str, least: int, near: float, smallest: int = 4) -> DataFrame:
    """(keys, first, last, lines): runs of at least ``least`` lines with nearly the same distance from each to the next.

    A distance may differ from the one before by ``near`` of it and a pixel; the first one of a run must be ``smallest``.
    Where a run ends, its last line may begin the next one with the line that didn't fit, unless the run was given."""
    group = "struct<first:bigint,last:bigint,lines:bigint>"
    ys = F.transform("at", lambda p: p["y"])
    first = F.get(ys, F.lit(0))
    start = F.struct(first.alias("first"), first.alias("last"), F.lit(0).cast("long").alias("step"), F.lit(1).cast("long").alias("lines"), F.array().cast(f"array<{group}>").alias("out"))
    given = lambda a: F.when(a["lines"] >= least, F.array_append(a["out"], F.struct(a["first"].alias("first"), a["last"].alias("last"), a["lines"].alias("lines")))).otherwise(a["out"])

    def step(a: Column, line: Column) -> Column:
        apart = line - a["last"]
        fits = F.when(a["lines"] == 1, apart >= smallest).otherwise(F.abs(apart - a["step"]) <= near * a["step"] + 1)
        shares = ~fits & (a["lines"] < least) & (apart >= smallest)
        return F.struct(
            F.when(fits, a["first"]).when(shares, a["last"]).otherwise(line).alias("first"), line.alias("last"), apart.alias("step"),
            F.when(fits, a["lines"] + 1).when(shares, 2).otherwise(1).cast("long").alias("lines"),
            F.when(fits, a["out"]).otherwise(given(a)).alias("out"),
        )

    rows = in_order(lines.select(*keys, c(y).cast("long").alias("y")).distinct(), keys, "y")
    return rows.select(*keys, F.inline(F.aggregate(F.slice(ys, 2, F.size("at")), start, step, given)))


# ----------------------------------------------------------------- over time


def share_changed(a, b, rows: int, cols: int, delta: float) -> float:
    moved = [sum(abs(a[r * cols + k] - b[r * cols + k]) > delta for r in range(rows)) for k in range(cols)]
    return sum(m >= 2 for m in moved) / cols


class MergeAdjacent(Fold):
    """Neighbours with the same content become one page over their joint span. The page shown is
    the longer-lived one, and later neighbours are compared with the page that is shown."""

    same, delta = 0.7, 0.15

    def row(self, item, start, end, values):
        values = [round(float(v), 6) for v in values]
        if self.s is not None:
            kept, vec, first, last = self.s
            if share_changed(vec, values, 8, 8, self.delta) < self.same:
                if last - first >= end - start:
                    self.s = [kept, vec, first, end]
                else:
                    self.s = [item, values, first, end]
                return []
        out = self.end()
        self.s = [item, values, start, end]
        return out

    def end(self):
        return [] if self.s is None else [(self.s[0], self.s[2], self.s[3])]


class Screens(Fold):
    """Sightings of items over screens; one seen on both sides of a screen change is given once, over the joint span.

    Two sightings are of one item if both were lit, the second soon after the first, and both together not much longer
    than an item is (``typical``); or else if they look alike, by their packed bitmaps. What the one that is given shows is the
    complete sighting, then the wider one, then the first."""

    def __init__(self, state=None, gap=1.0, stretch=1.4, alike=0.35):
        super().__init__(state)
        self.gap, self.stretch, self.alike = gap, stretch, alike

    def one_item(self, old: dict, new: dict, typical: float) -> bool:
        if old["screen"] == new["screen"]:
            return False
        if not (old["lit"] and new["lit"]):
            return word_mismatch(old["sig"], new["sig"]) < self.alike
        return 0 < typical and new["start"] <= old["end"] + self.gap and new["end"] - old["start"] <= self.stretch * typical

    def row(self, screen, x0, x1, start, end, complete, typical, lit=True, sig=0):
        new = {"screen": screen, "x0": x0, "x1": x1, "start": start, "end": end, "complete": bool(complete), "lit": bool(lit), "sig": int(sig)}
        old, self.s = self.s, new
        if old is None:
            return []
        if not self.one_item(old, new, typical):
            return [self.given(old)]
        shown = max(old, new, key=lambda s: (s["complete"], s["x1"] - s["x0"]))  # the first of equals
        self.s = shown | {"start": old["start"], "end": end}
        return []

    @staticmethod
    def given(s: dict) -> tuple:
        return tuple(s[k] for k in ("screen", "x0", "x1", "start", "end", "complete"))

    def end(self):
        return [] if self.s is None else [self.given(self.s)]
