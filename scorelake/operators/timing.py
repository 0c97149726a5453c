"""Rhythm: candidate readings, exact-sum solving, writable voices, beams, alignment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators.ordered import spread_over

# Note values a reading may have, and the price of a triplet read without its "3".
READABLE = (1, 2, 4, 8, 16, 32)
TRIPLET_P = 0.02

OPTION = "struct<duration:bigint,dots:bigint,tuplet:bigint,p:double>"


def _option(d: Column, dots, tuplet, p) -> Column:
    as_long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(
        d.cast("long").alias("duration"),
        as_long(dots).alias("dots"),
        as_long(tuplet).alias("tuplet"),
        (p if isinstance(p, Column) else F.lit(p)).cast("double").alias("p"),
    )


#: Evidence whose readings are worked out once: beams, tuplets and guesses as they are met on pages.
BEAMS, MET_TUPLETS, RESTS = (0, 1, 2, 3, 4), (None, *sorted(tk.TUPLETS)), ("rest_block", "rest_4", "rest_8", "rest_16")


def _evidence_code(
    stem: Column, beams: Column, beam_conf: Column, dot: Column, tuplet: Column,
    circled: Column, rest_kind: Column, short_stem: Column, spacing_guess: Column,
) -> Column:
    """Number of the evidence among the usual ones, null for any other. What doesn't matter to a kind of beat is left
    out, so equal numbers have equal readings."""
    of = lambda value, known: F.when(value.isin(*known), value).cast("long")
    bit = lambda flag, place: F.when(flag, 1 << place).when(~flag, 0).cast("long")
    mark = F.when(tuplet.isNull(), 0).otherwise(of(tuplet, MET_TUPLETS[1:])).cast("long")
    half = F.when(beams != 0, F.lit(False)).otherwise(short_stem | circled)
    stems = of(beams, BEAMS) * 16 + mark * 128 + bit(half, 0) + bit(dot, 1) + bit(beam_conf >= 0.7, 2) + 8
    rest = F.coalesce(*[F.when(rest_kind == r, -1 - i) for i, r in enumerate(RESTS)])
    guess = F.coalesce(spacing_guess, F.lit(4).cast("long"))
    other = F.when(circled, -5).otherwise(of(guess, READABLE) * -1 - 5)
    return F.when(rest_kind.isNotNull(), rest).when(stem, stems).when(~stem, other).cast("long")


def _usual_evidence(spark: SparkSession, **kinds: str) -> DataFrame:
    rows = [(False, 0, 0.0, False, None, False, r, False, None) for r in RESTS]
    rows += [(False, 0, 0.0, False, None, True, None, False, None)]
    rows += [(False, 0, 0.0, False, None, False, None, False, g) for g in READABLE]
    rows += [
        (True, b, q, dot, tup, False, None, half, None)
        for b in BEAMS for q in (0.0, 0.7) for dot in (False, True) for tup in MET_TUPLETS
        for half in ((False, True) if b == 0 else (False,))
    ]
    names = ("stem", "beams", "beam_conf", "dot", "tuplet", "circled", "rest_kind", "short_stem", "spacing_guess")
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names))


def with_readings(df: DataFrame, name: str, **evidence: str) -> DataFrame:
    """Adds the possible durations of each beat as an array, in the order they are thought of;
    the same reading twice keeps the higher probability. ``evidence`` names the columns.

    Readings of the usual evidence come from a fixed table of some 150 rows; any other is worked out in its row."""
    kinds = {"stem": "boolean", "beams": "bigint", "beam_conf": "double", "dot": "boolean", "tuplet": "bigint",
             "circled": "boolean", "rest_kind": "string", "short_stem": "boolean", "spacing_guess": "bigint"}
    usual = _usual_evidence(df.sparkSession, **kinds)
    usual = usual.withColumn("_code", _evidence_code(**{k: F.col(k) for k in kinds}))
    usual = _worked_out(usual, "_known", _readings(**{k: F.col(k) for k in kinds})).select("_code", "_known")
    cols = {k: F.col(v) for k, v in evidence.items()}
    found = df.withColumn("_code", _evidence_code(**cols)).join(F.broadcast(usual), "_code", "left")
    raw = F.when(F.col("_known").isNull(), _readings(**cols))
    out = _worked_out(found, "_rare", raw)
    return out.select(*df.columns, F.coalesce("_known", "_rare").alias(name))


def _worked_out(df: DataFrame, name: str, raw: Column) -> DataFrame:
    key = lambda o: F.struct(o["duration"], o["dots"], o["tuplet"])
    tagged = F.transform(
        "_raw",
        lambda o, i: F.struct(
            o["duration"].alias("duration"), o["dots"].alias("dots"), o["tuplet"].alias("tuplet"),
            i.alias("i"), o["p"].alias("p"),
        ),
    )
    readable = F.array_sort(F.filter(tagged, lambda o: o["duration"].isin(*READABLE) & (o["p"] > 0)))
    near = F.col("_valid")  # sorted by reading, so the same ones (four at most) lie together

    def best(o: Column, i: Column) -> Column:
        more = [F.get(near, i + k) for k in (1, 2, 3)]
        return F.greatest(o["p"], *[F.when(key(m).eqNullSafe(key(o)), m["p"]) for m in more])

    merged = F.transform(
        near,
        lambda o, i: F.when(
            (i == 0) | ~key(F.get(near, i - 1)).eqNullSafe(key(o)),
            F.struct(
                o["i"].alias("i"), o["duration"].alias("duration"), o["dots"].alias("dots"),
                o["tuplet"].alias("tuplet"), best(o, i).alias("p"),
            ),
        ),
    )
    kept = F.array_sort(F.filter(merged, lambda o: o.isNotNull()))
    # one step per column, so that no array is built more than once
    return df.withColumn("_raw", raw).withColumn("_valid", readable).withColumn(name, kept).drop(
        "_raw", "_valid"
    )


def _readings(
    stem: Column, beams: Column, beam_conf: Column, dot: Column, tuplet: Column,
    circled: Column, rest_kind: Column, short_stem: Column, spacing_guess: Column,
) -> Column:
    none = F.lit(None).cast("long")

    def rest(values: list[tuple[int, float]]) -> Column:
        out = []
        for v, p in values:
            out += [_option(F.lit(v), 0, none, p), _option(F.lit(v), 1, none, F.lit(p) * 0.08)]
            out += [_option(F.lit(v * 2), 0, none, F.lit(p) * 0.05)]
            out += [_option(F.lit(v // 2), 0, none, F.lit(p) * 0.05)]
        return F.array(*out)

    rests = (
        F.when(rest_kind == "rest_block", rest([(1, 0.5), (2, 0.45)]))
        .when(rest_kind == "rest_4", rest([(4, 0.9)]))
        .when(rest_kind == "rest_8", rest([(8, 0.9)]))
        .otherwise(rest([(16, 0.9)]))
    )
    beamed = F.call_function("shiftleft", F.lit(4).cast("long"), beams.cast("int"))
    d = F.when((beams == 0) & (short_stem | circled), F.lit(2).cast("long")).otherwise(beamed)
    dots = F.when(dot, 1).otherwise(0)
    sure = F.when(beam_conf >= 0.7, F.lit(0.9)).otherwise(F.lit(0.7))
    half = (1 - sure) * 0.5
    never = F.lit(0.0)
    stems = F.array(
        _option(d, dots, tuplet, sure),
        _option(d, 1 - dots, tuplet, 0.03),
        _option(beamed * 2, dots, tuplet, half),
        _option(F.floor(beamed / 2), dots, tuplet, F.when(beams > 0, half).otherwise(never)),
        _option(
            F.when(d == 2, F.lit(4)).otherwise(F.lit(2)), dots, tuplet,
            F.when(beams > 0, never).when(d == 2, F.lit(0.01)).otherwise(F.lit(0.08)),
        ),
        _option(d, dots, none, F.when(tuplet.isNotNull(), F.lit(0.05)).otherwise(never)),
    )
    rings = F.array(
        *[_option(F.lit(v), k, none, p) for v, k, p in ((1, 0, 0.85), (2, 0, 0.08), (1, 1, 0.02), (2, 1, 0.02))]
    )
    guess = F.coalesce(spacing_guess, F.lit(4).cast("long"))
    spaced = F.array(*[
        _option(
            F.lit(v), k, none,
            F.lit(p) * F.pow(F.lit(0.25), F.abs(F.lit(math.log2(v)) - F.log2(guess.cast("double")))),
        )
        for v in READABLE for k, p in ((0, 0.4), (1, 0.05))
    ])
    return F.when(rest_kind.isNotNull(), rests).when(stem, stems).when(circled, rings).otherwise(spaced)


def dotted_rest_preference(options: Column, rest_kind: Column, dot: Column) -> Column:
    """A dot beside a rest makes its dotted readings likely, the plain ones not."""
    dotted_rest = rest_kind.isNotNull() & dot
    factor = lambda o: F.when(o["dots"] > 0, 12.0).otherwise(0.1)
    liked = F.transform(options, lambda o: o.withField("p", o["p"] * factor(o)))
    return F.when(dotted_rest, liked).when(~dotted_rest, options)


def _length(o: dict) -> int:
    n, t = tk.plain(int(o["duration"]), int(o["dots"])), o["tuplet"]
    return n if not t else n * tk.TUPLETS.get(int(t), int(t)) // int(t)


class Beat:
    """Readings of a beat, likeliest first, as ``(ticks, log p, place)``; of those of one length only the likeliest one,
    since no other is ever chosen. ``top``, ``top_log``: the likeliest one and the log of it; ``total``: of all."""

    def __init__(self, options: list[tuple]):
        order = sorted(range(len(options)), key=lambda k: -options[k][3])
        lengths = [_length(dict(zip(("duration", "dots", "tuplet"), o, strict=False))) for o in options]
        self.steps, self.by_ticks = [], {}
        for k in order:
            if lengths[k] not in self.by_ticks:
                self.by_ticks[lengths[k]] = (math.log(options[k][3]), k)
                self.steps.append((lengths[k], math.log(options[k][3]), k))
        self.top, self.place = options[order[0]], order[0]
        self.top_log = math.log(self.top[3])
        self.total = sum(o[3] for o in options)


def best_places(beats: list[Beat], room: int, triplets: bool = True) -> tuple[tuple[int, ...], bool, float]:
    """``(places, ok, score)``: the place of one reading per beat, with the highest joint probability whose lengths add up
    to ``room``; -1 for beats read as a triplet. Without such a choice the likeliest reading of each beat."""
    if not beats:
        return (), True, 0.0
    last = len(beats)
    thirds = [_triplet(beats[at : at + 3]) if triplets else None for at in range(last)]
    # what the beats from here on take at least and at most: totals out of reach of the room are left out
    least, most = [0] * (last + 1), [0] * (last + 1)
    for at in range(last - 1, -1, -1):
        least[at] = min(beats[at].by_ticks) + least[at + 1]
        most[at] = max(beats[at].by_ticks) + most[at + 1]
        if thirds[at] is not None:
            least[at] = min(least[at], thirds[at][0] + least[at + 3])
            most[at] = max(most[at], thirds[at][0] + most[at + 3])
    # per beat count: total -> (score, step back), a step being (place, step back)
    reached: list[dict[int, tuple[float, tuple | None]]] = [{} for _ in range(last + 1)]
    reached[0][0] = (0.0, None)
    for at in range(last):
        onward, third = reached[at + 1], thirds[at]
        low, high = room - most[at + 1], room - least[at + 1]
        steps, by_ticks = beats[at].steps, beats[at].by_ticks
        for total, (score, way) in reached[at].items():
            if at == last - 1:  # the last beat has to fill the room
                lp, place = by_ticks.get(room - total, (None, None))
                if lp is not None:
                    known = onward.get(room)
                    if known is None or known[0] < score + lp:
                        onward[room] = (score + lp, (place, way))
            else:
                for ticks, lp, place in steps:
                    now = total + ticks
                    if low <= now <= high:
                        known = onward.get(now)
                        if known is None or known[0] < score + lp:
                            onward[now] = (score + lp, (place, way))
            if third is not None:
                now, value = total + third[0], score + third[1]
                beyond = reached[at + 3]
                if now <= room and (now not in beyond or beyond[now][0] < value):
                    beyond[now] = (value, (-1, way))
    if room not in reached[last]:
        return tuple(b.place for b in beats), False, sum(b.top_log for b in beats)
    score, way = reached[last][room]
    places: list[int] = []
    while way is not None:
        place, way = way
        places += [-1] * 3 if place < 0 else [place]
    return tuple(places[::-1]), True, score


def _triplet(three: list[Beat]) -> tuple[int, float] | None:
    """Ticks and log probability of three plain beats of one value read as a triplet."""
    if len(three) < 3:
        return None
    tops = [b.top for b in three]
    if any(o[0] != tops[0][0] or o[1] or o[2] is not None for o in tops):
        return None
    ticks = 3 * _length({"duration": tops[0][0], "dots": 0, "tuplet": 3})
    return ticks, math.log(TRIPLET_P) + sum(b.top_log for b in three)


def best_exact_sum(beats: list[list[dict]], room: int, triplets: bool = True):
    """``(chosen, ok, score)``: the readings of :func:`best_places`."""
    ready = [Beat([(o["duration"], o["dots"], o["tuplet"], o["p"]) for o in b]) for b in beats]
    places, ok, score = best_places(ready, room, triplets)
    tripled = lambda b: {**dict(zip(("duration", "dots", "tuplet", "p"), b.top, strict=True)), "tuplet": 3}
    return [tripled(r) if k < 0 else b[k] for b, r, k in zip(beats, ready, places, strict=True)], ok, score


#: What a worker remembers: beats by their readings, measures by their beats. Both are forgotten when full.
KEPT_BEATS, KEPT_MEASURES = 1 << 14, 1 << 17


class Solver:
    """Measures of a worker: equal ones are solved once while they are remembered."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.beats: list[Beat] = []
        self.known: dict[tuple, tuple] = {}

    def solve(self, batch: pa.RecordBatch, options: str, room: str) -> tuple[pa.Array, dict[str, np.ndarray]]:
        """The beats of a batch of measures in order, and the columns chosen for them with ``row``, their measure."""
        lists = batch.column("_beats")
        beats = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        readings = beats.field(options)
        cuts = readings.offsets.to_numpy()
        base, cuts = int(cuts[0]), cuts - cuts[0]
        flat = readings.values.slice(base, int(cuts[-1]))
        whole = [flat.field(n) for n in ("duration", "dots", "tuplet")]
        p = flat.field("p").to_numpy(zero_copy_only=False)
        table = np.stack([a.fill_null(-1).to_numpy(zero_copy_only=False) for a in whole] + [p.view(np.int64)], axis=1)
        raw, n = table.tobytes(), table.shape[1] * 8
        ends, starts = (cuts[1:] * n).tolist(), (cuts[:-1] * n).tolist()
        if len(self.ids) > KEPT_BEATS or len(self.known) > KEPT_MEASURES:
            self.__init__()
        keys = []
        for a, b in zip(starts, ends, strict=True):
            key = raw[a:b]
            i = self.ids.get(key)
            if i is None:
                i = self.ids[key] = len(self.beats)
                rows = table[a // n : b // n].tolist()
                probable = p[a // n : b // n].tolist()
                self.beats.append(Beat([(r[0], r[1], None if r[2] == -1 else r[2], q) for r, q in zip(rows, probable, strict=True)]))
            keys.append(i)
        places: list[int] = []
        oks, scores, at = [], [], 0
        rooms, allowed = batch.column(room).to_pylist(), batch.column("_triplets").to_pylist()
        for size, space, triplets in zip(sizes.tolist(), rooms, allowed, strict=True):
            measure = (space, bool(triplets), *keys[at : at + size])
            found = self.known.get(measure)
            if found is None:
                found = best_places([self.beats[i] for i in measure[2:]], int(space), bool(triplets))
                self.known[measure] = found
            places += found[0]
            oks.append(found[1])
            scores.append(found[2])
            at += size
        place = np.array(places, dtype=np.int64)
        tripled = place < 0
        likeliest = np.array([b.place for b in self.beats], dtype=np.int64)[keys] if keys else place
        pick = cuts[:-1] + np.where(tripled, likeliest, place)
        row = np.repeat(np.arange(len(sizes)), sizes)
        tuplet = np.where(tripled, 3, table[pick, 2])
        return beats, {
            "row": row, "duration": table[pick, 0], "dots": table[pick, 1], "tuplet": tuplet, "p": p[pick],
            "total": np.array([b.total for b in self.beats])[keys] if keys else p[pick],
            "ok": np.array(oks, dtype=bool)[row], "score": np.array(scores, dtype=float)[row],
        }


def solve_measures(
    df: DataFrame, measure: Sequence[str], order: str, options: str, room: str,
    triplets: Column | None = None,
) -> DataFrame:
    """Exact-sum durations per measure. The readings of a measure (a handful of beats) travel
    as one row, so the solver runs on Arrow batches of measures. Unmarked triplets are tried
    where ``triplets`` holds for all beats, by default everywhere."""
    allowed = F.lit(True) if triplets is None else triplets
    rows = spread_over(df, measure).groupBy(*measure, room).agg(
        F.array_sort(F.collect_list(F.struct(order, options))).alias("_beats"), F.bool_and(allowed).alias("_triplets")
    )
    return solve_rows(rows, measure, order, options, room)


def solve_rows(rows: DataFrame, measure: Sequence[str], order: str, options: str, room: str) -> DataFrame:
    """The same for measures that are one row each: ``_beats`` as structs of ``order`` and ``options``, and ``_triplets``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["_beats"].dataType.elementType}
    kinds |= {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [f"{k} {kinds[k]}" for k in measure]
        + [f"{order} {kinds[order]}", "duration bigint, dots bigint, tuplet bigint, p double"]
        + ["total double, ok boolean, score double"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            beats, made = solver.solve(batch, options, room)
            row = made.pop("row")
            kept = [batch.column(k).take(pa.array(row)) for k in measure] + [beats.field(order)]
            tuplet = made["tuplet"]
            found = [pa.array(v, mask=tuplet == -1) if k == "tuplet" else pa.array(v) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*measure, order, *made])

    return rows.mapInArrow(run, schema)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value inside a lambda, where Spark would work it out anew at each place that names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def placed_voices(
    df: DataFrame, voice: Sequence[str], room: str, extra: Sequence[str] = (), in_place: bool = False
) -> DataFrame:
    """Voices made writable: beats in time order, none before the end of the one before, none
    past the measure end; a beat too long for the room before the next one is shortened and
    spelled again.

    ``df`` has ``pos, onset, duration, dots, tuplet, rest``; a measure's voice is a few beats
    and is folded as one array inside the JVM. ``extra`` columns of a beat stay with it.
    ``in_place``: beats stay where they lie, and a voice without a place for any is a row without ``pos``."""
    kinds = dict(df.dtypes)
    own = tk.length(F.col("duration"), F.col("dots"), F.col("tuplet")).alias("_own")
    beats = (df if in_place else spread_over(df, voice)).groupBy(*voice, room).agg(
        F.array_sort(
            F.collect_list(F.struct("onset", "pos", "duration", "dots", "tuplet", "rest", *extra, own))
        ).alias("_b")
    )
    cap = F.col(room)
    more = "".join(f",{x}:{kinds[x]}" for x in extra)
    empty = F.array().cast(
        "array<struct<pos:bigint,start:bigint,length:bigint,duration:bigint,dots:bigint,"
        f"tuplet:bigint,rest:boolean{more}>>"
    )

    def step(acc: Column, b: Column) -> Column:
        return _once(F.greatest(b["onset"], acc["at"]), lambda start: _once(left(start), lambda room: placed(acc, b, start, room)))

    def left(start: Column) -> Column:
        later = F.filter(F.col("_b"), lambda n: n["onset"] > start)
        return F.least(F.coalesce(F.array_min(F.transform(later, lambda n: n["onset"])), cap), cap) - start

    def placed(acc: Column, b: Column, start: Column, room_left: Column) -> Column:
        long_ = b["_own"] > room_left
        plain = F.struct(b["duration"].alias("value"), b["dots"].alias("dots"), b["_own"].alias("ticks"))
        return _once(F.when(long_, tk.largest_fitting(room_left)).otherwise(plain), lambda cut: onward(acc, b, start, ~long_, cut))

    def onward(acc: Column, b: Column, start: Column, kept: Column, cut: Column) -> Column:
        row = F.struct(
            b["pos"].alias("pos"),
            start.alias("start"),
            cut["ticks"].alias("length"),
            cut["value"].alias("duration"),
            cut["dots"].alias("dots"),
            F.when(kept, b["tuplet"]).alias("tuplet"),
            b["rest"].alias("rest"),
            *[b[x].alias(x) for x in extra],
        )
        full = acc["full"] | (start >= cap)
        return F.struct(
            F.when(full, acc["at"]).otherwise(start + cut["ticks"]).alias("at"),
            full.alias("full"),
            F.when(full, acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"),
        )

    zero = F.struct(
        F.lit(0).cast("long").alias("at"), F.lit(False).alias("full"), empty.alias("out")
    )
    folded = beats.select(*voice, room, F.aggregate("_b", zero, step)["out"].alias("_o"))
    # the plain form would test the size of the array first and fold it twice
    rows = folded.select(*voice, room, F.explode_outer("_o").alias("p"))
    return (rows if in_place else rows.where(F.col("p.pos").isNotNull())).select(*voice, room, "p.*")


def beamed(df: DataFrame, voice: Sequence[str], beat: Column) -> DataFrame:
    """Placed beats with their ``beams``, an array of ``(level, kind)``: neighbours in time within one beat, all shorter
    than a quarter, are joined; level k joins neighbours that both have k beams, a lone one gets a hook.

    What a level looks like is told by the neighbours alone, so beats stay one row each."""
    w = Window.partitionBy(*voice).orderBy("start", "pos")
    count = tk.lookup({8: 1, 16: 2, 32: 3, 64: 4}, F.col("duration").cast("int"))
    df = df.withColumns({
        "_n": F.when(F.col("rest"), 0).otherwise(F.coalesce(count, F.lit(0))),
        "_beat": F.floor(F.col("start") / beat),
        "_end": F.col("start") + F.col("length"),
    })
    joins = (
        (F.col("_n") > 0)
        & (F.lag("_n").over(w) > 0)
        & (F.lag("_beat").over(w) == F.col("_beat"))
        & (F.lag("_end").over(w) == F.col("start"))
    )
    df = df.withColumn("_joined", F.coalesce(joins, F.lit(False)))
    df = df.withColumns({
        "_left": F.when(F.col("_joined"), F.lag("_n").over(w)).otherwise(0),
        "_right": F.when(F.lead("_joined").over(w), F.lead("_n").over(w)).otherwise(0),
    })

    def kind(level: Column) -> Column:
        left, right = F.col("_left") >= level, F.col("_right") >= level
        hook = F.when(F.col("_joined"), "backward hook").otherwise("forward hook")
        return F.when(~left & ~right, hook).when(~left, "begin").when(~right, "end").otherwise("continue")

    level = lambda k: F.struct(k.cast("long").alias("level"), kind(k).alias("kind"))
    alone = (F.col("_left") == 0) & (F.col("_right") == 0)
    marks = F.when(~alone, F.transform(F.sequence(F.lit(1), F.col("_n")), level))
    return df.withColumn("beams", marks).drop("_n", "_beat", "_end", "_joined", "_left", "_right")


def beams(df: DataFrame, voice: Sequence[str], beat: Column) -> DataFrame:
    """``beamed`` as a row per beam: ``(voice..., pos, level, kind)``."""
    return beamed(df, voice, beat).select(*voice, "pos", F.inline("beams"))


def with_gaps(df: DataFrame, voice: Sequence[str], room: str) -> DataFrame:
    """Placed beats with ``gaps``, an array of the empty stretches ``(start, length)`` before each and, for the last one,
    up to the measure end."""
    w = Window.partitionBy(*voice).orderBy("start", "pos")
    whole = Window.partitionBy(*voice, room)
    last = F.lead("start").over(whole.orderBy("start", "pos")).isNull()
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    ends = df.withColumn("_end", F.col("start") + F.col("length")).select(
        *df.columns, F.coalesce(F.lag("_end").over(w), F.lit(0).cast("long")).alias("_before"),
        F.max("_end").over(whole).alias("_all"), last.alias("_at_end"),
    )
    both = F.array(gap(F.col("_before"), F.col("start")), gap(F.when(F.col("_at_end"), F.col("_all")), F.col(room)))
    found = F.transform(F.filter(both, lambda g: g["b"] > g["a"]), lambda g: F.struct(g["a"].alias("start"), (g["b"] - g["a"]).alias("length")))
    return ends.select(*df.columns, found.alias("gaps"))


def gap_rows(df: DataFrame, voice: Sequence[str], room: str) -> DataFrame:
    """Empty stretches ``(start, length)`` before placed beats and up to the measure end."""
    return with_gaps(df, voice, room).select(*voice, F.inline("gaps"))


def nearest_fraction(value: Column, most: int) -> Column:
    """``(p, q)`` of the fraction with ``q <= most`` nearest to ``value``, the smallest ``q``."""
    tries = F.transform(
        F.array(*[F.lit(float(q)) for q in range(1, most + 1)]),
        lambda q: F.struct(F.abs(value - F.rint(value * q) / q).alias("e"), q.alias("q"), F.rint(value * q).alias("p")),
    )
    return F.array_min(tries).cast("struct<e:double,q:int,p:bigint>")


def aligned_onsets(
    events: DataFrame, anchors: DataFrame, measure: Sequence[str], near: int, grid: int, room: str
) -> DataFrame:
    """Onsets of one voice from where it lines up with the other: the onset of the anchor
    within ``near``, else interpolated between the anchors on both sides and rounded to the
    grid. Both voices belong to one measure, a handful of beats."""
    pairs = events.join(anchors.withColumnsRenamed({"x": "ax", "onset": "ao"}), [*measure])
    a = F.struct("ax", "ao")
    gap = F.abs(F.col("ax") - F.col("x"))
    near_row = F.min_by(a, F.struct(gap, F.col("ax"), F.col("ao")))
    left = F.max_by(a, F.when(F.col("ax") < F.col("x"), F.struct("ax", -F.col("ao"))))
    right = F.min_by(a, F.when(F.col("ax") > F.col("x"), F.struct("ax", "ao")))
    keys = [*measure, *[c for c in events.columns if c not in measure]]
    found = pairs.groupBy(*keys).agg(
        near_row.alias("n"), left.alias("l"), right.alias("r")
    )
    found = aligned_places(found, near, F.lit(grid), room, "onset", "exact")
    return found.select(*keys, "onset", "exact")


def aligned_places(found: DataFrame, near: int, grid: Column, room: str, onset: str, exact: str) -> DataFrame:
    """Adds the onset of the place ``x`` and whether it lies on an anchor, given the nearest anchor ``n`` and those on
    both sides, ``l`` and ``r``, as structs ``(ax, ao)``."""
    f = (F.col("x") - F.col("l.ax")) / (F.col("r.ax") - F.col("l.ax"))
    on = F.abs(F.col("n.ax") - F.col("x")) <= near
    alone = on | F.col("l").isNull() | F.col("r").isNull()
    # as in nearest_fraction, by plain arrays of numbers; places that lie on an anchor need none
    away = F.transform(F.array(*[F.lit(float(q)) for q in range(1, 65)]), lambda q: F.abs(F.col("_at") - F.rint(F.col("_at") * q) / q))
    found = found.withColumn("_at", F.when(~alone, f)).withColumn("_away", F.when(F.col("_at").isNotNull(), away))
    q, p = F.col("_q"), F.rint(F.col("_at") * F.col("_q")).cast("long")
    found = found.withColumn("_q", F.array_position("_away", F.array_min("_away"))).drop("_away").withColumns({
        "_top": F.col("l.ao") * q + (F.col("r.ao") - F.col("l.ao")) * p,
        "_bottom": q * grid,
    })
    top, bottom, whole = F.col("_top"), F.col("_bottom"), F.col("_whole")
    rest2 = (top - whole * bottom) * 2
    up = F.when(rest2 > bottom, 1).when(rest2 < bottom, 0).otherwise(whole % 2)
    snapped = F.least(F.col(room) - grid, F.greatest(F.lit(0).cast("long"), (whole + up) * grid))
    place = F.when(alone, F.col("n.ao")).otherwise(snapped)
    found = found.withColumn("_whole", F.floor(top / bottom)).withColumns({onset: place, exact: on})
    return found.drop("_at", "_q", "_top", "_bottom", "_whole")
