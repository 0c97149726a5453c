"""An edit log applied in bulk: per target the last edit counts, toggles by their parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import ticks as tk
from scorelake.operators.ordered import CHUNK, by_rows, chunked, cut_columns, following, latest, running_sum, scan, tasks_of, upcoming
from scorelake.sources.checks import is_kind

c = F.col

# Closed sets of technique values.
HARMONICS = ("natural", "artificial", "pinch", "tap", "semi", "feedback")
MOST_FRET = 30


def last_edits(edits: DataFrame, target: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The edit with the highest ``seq`` per target; merged before the exchange."""
    return edits.groupBy(*target).agg(F.max_by(F.struct(*cols), "seq").alias("_e")).select(
        *target, *[c("_e")[x].alias(x) for x in cols]
    )


def toggles(edits: DataFrame, target: Sequence[str], name: str) -> DataFrame:
    return edits.groupBy(*target).agg(F.count("*").alias(name))


def set_frets(notes: DataFrame, edits: DataFrame, target: Sequence[str]) -> DataFrame:
    """``op``: ``set`` a fret (the tie stays), mark ``dead`` (never tied), ``clear`` the string. A
    string without a note gets one. Frets beyond the neck are no valid edits."""
    valid = edits.where((c("op") != "set") | c("value").between(0, MOST_FRET))
    last = last_edits(valid, target, ["op", "value"])
    joined = notes.join(last, [*target], "full_outer").where(~c("op").eqNullSafe("clear"))
    edited = c("op").isNotNull()
    return joined.select(
        *target,
        F.when(c("op") == "set", c("value")).when(c("op") == "dead", 0).otherwise(c("fret")).alias("fret"),
        F.when(edited, c("op") == "dead").otherwise(c("dead")).alias("dead"),
        (F.coalesce("tied", F.lit(False)) & ~F.coalesce(c("op") == "dead", F.lit(False))).alias("tied"),
        F.when(edited, 1.0).otherwise(c("conf")).alias("conf"),
    )


def toggle_ties(notes: DataFrame, edits: DataFrame, target: Sequence[str]) -> DataFrame:
    n = toggles(edits, target, "_n")
    flip = (F.coalesce("_n", F.lit(0)) % 2 == 1) & ~c("dead")
    return notes.join(n, [*target], "left").withColumn("tied", c("tied") != flip).drop("_n")


def harmonic_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid edits of the harmonic (null clears it) and the rejected ones."""
    good = c("kind").isNull() | c("kind").isin(*HARMONICS)
    return edits.where(good), edits.where(~good)


def set_harmonics(notes: DataFrame, edits: DataFrame, target: Sequence[str]) -> DataFrame:
    """A harmonic gets a fret if it has none: a natural one the note's own, else an octave."""
    last = last_edits(edits, target, ["kind"]).withColumn("_hit", F.lit(True))
    joined = notes.join(last, [*target], "left")
    own = F.coalesce("harmonic_fret", F.when(c("kind") == "natural", c("fret")).otherwise(12))
    return joined.withColumns({
        "harmonic_fret": F.when(c("_hit"), F.when(c("kind").isNotNull(), own)).otherwise(c("harmonic_fret")),
        "harmonic": F.when(c("_hit"), c("kind")).otherwise(c("harmonic")),
    }).drop("kind", "_hit")


def toggle_beats(notes: DataFrame, edits: DataFrame, beat: Sequence[str], mark: str) -> DataFrame:
    """Mark all notes of a beat, or clear them when all were marked; again per further toggle."""
    n = toggles(edits, beat, "_n")
    # only beats with edits are looked at; a beat is a few notes
    every = notes.join(n, [*beat], "left_semi").groupBy(*beat).agg(F.bool_and(mark).alias("_all"))
    state = every.join(n, [*beat]).withColumn("_to", F.when(c("_n") % 2 == 1, ~c("_all")).otherwise(c("_all")))
    return notes.join(state.select(*beat, "_to"), [*beat], "left").withColumn(
        mark, F.coalesce("_to", mark)
    ).drop("_to")


def change_beats(beats: DataFrame, edits: DataFrame, target: Sequence[str]) -> DataFrame:
    """``duration`` is set, ``dot``, ``triplet`` and ``rest`` are toggled."""
    change = edits.groupBy(*target).agg(
        F.max_by("value", F.when(c("op") == "duration", c("seq"))).alias("_d"),
        *[F.count_if(c("op") == o).alias(f"_{o}") for o in ("dot", "triplet", "rest")],
    )
    odd = lambda o: F.coalesce(c(f"_{o}"), F.lit(0)) % 2 == 1
    return beats.join(change, [*target], "left").withColumns({
        "duration": F.coalesce("_d", "duration"),
        "dots": F.when(odd("dot"), F.when(c("dots") > 0, 0).otherwise(1)).otherwise(c("dots")),
        "tuplet": F.when(odd("triplet"), F.when(c("tuplet").isNull(), 3)).otherwise(c("tuplet")),
        "rest": c("rest") != odd("rest"),
    }).drop("_d", "_dot", "_triplet", "_rest")


def insert_and_delete(beats: DataFrame, edits: DataFrame, measure: Sequence[str]) -> DataFrame:
    """Rests put in ``before`` or ``after`` a beat with its duration, beats taken out by
    ``delete``; a measure left without beats becomes a whole rest. Positions are those before
    all edits; beats are numbered anew.

    Beats and edits meet once, in the order of the result, the deletions of a beat right before it. A measure's beats are few by meaning and its edits may be many, so measures are cut among edits."""
    kinds = dict(beats.dtypes)
    long = lambda v: F.lit(v).cast("long")
    side = F.when(c("op") == "before", -1).when(c("op") == "after", 1).otherwise(0).cast("long")
    log = edits.where(c("op").isin("before", "after", "delete")).select(
        *measure, (c("pos") * 2 + side).cast("long").alias("_at"), F.when(side == 0, 0).otherwise(1).cast("long").alias("_turn"),
        c("seq").cast("long").alias("_seq"), c("pos").cast("long").alias("pos"), side.alias("_side"),
    )
    own = beats.select(*measure, (c("pos") * 2).cast("long").alias("_at"), long(2).alias("_turn"), long(-1).alias("_seq"), c("pos").cast("long").alias("pos"), long(0).alias("_side"), "duration", "rest")
    order = ["_at", "_turn", "_seq"]
    rows = chunked(own.unionByName(log, allowMissingColumns=True), measure, order, among=log, more=tasks_of(beats))
    is_beat = c("_turn") == 2
    at = F.when(is_beat, F.struct("pos", "duration"))
    seen = scan(by_rows(rows, [*measure, *(x for x in rows.columns if x == CHUNK)]), measure, order, {
        "_gone": latest(F.when(c("_turn") == 0, c("pos"))), "_before": latest(at), "_next": upcoming(at),
    }, keep=True)
    here = F.when(c("_side") < 0, c("_next")).when(c("_side") > 0, c("_before"))
    stays = F.when(is_beat, ~c("_gone").eqNullSafe(c("pos"))).otherwise(F.coalesce(here["pos"] == c("pos"), F.lit(False)))
    seen = seen.select(
        *cut_columns(seen), *measure, *order, F.when(is_beat, c("duration")).otherwise(here["duration"]).alias("duration"),
        F.when(is_beat, c("rest")).otherwise(True).alias("rest"), stays.alias("_stays"),
    )
    count = lambda flag: running_sum(flag.cast("long"))
    out = scan(seen, measure, order, {
        "number": count(c("_stays")), "_beats": count(is_beat), "_after": following(F.lit(True)),
    })
    # the last row of a measure without any that stays tells of the whole rest
    alone = c("_after").isNull() & (c("number") == 0) & (c("_beats") > 0)
    whole = F.lit(1).cast(kinds["duration"])
    return out.where(c("_stays") | alone).select(
        *measure, F.when(c("_stays"), c("duration")).otherwise(whole).alias("duration"),
        F.when(c("_stays"), c("rest")).otherwise(True).alias("rest"), F.when(c("_stays"), c("number")).otherwise(1).alias("number"),
    )


def confirm(beats: DataFrame, edits: DataFrame, measure: Sequence[str], room: Column) -> DataFrame:
    """Confirmed beats get confidence 1; so does a measure with one whose beats fill it exactly."""
    hit = edits.select(*measure, "pos").distinct().withColumn("_hit", F.lit(True))
    joined = beats.join(hit, [*measure, "pos"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    sums = joined.groupBy(*measure).agg(
        (F.sum(tk.length(c("duration"), c("dots"), c("tuplet"))) == F.first(room)).alias("_full"),
        F.bool_or("_hit").alias("_any"),
    )
    return joined.join(sums, [*measure]).withColumns({
        "conf": F.when(c("_hit"), 1.0).otherwise(c("conf")),
        "measure_conf": F.when(c("_any") & c("_full"), 1.0).otherwise(c("measure_conf")),
    }).drop("_hit", "_full", "_any")


def overrides_after(edits: DataFrame, preset: DataFrame, piece: Sequence[str]) -> DataFrame:
    """Overrides in force after the log: the last choice per key, none where it is what the
    preset says anyway, and none made before the piece's last change of preset."""
    reset = edits.where("op = 'preset'").groupBy(*piece).agg(F.max("seq").alias("_reset"))
    chosen = edits.where("op = 'choose'").join(reset, [*piece], "left").where(
        c("seq") > F.coalesce("_reset", F.lit(-1))
    )
    last = last_edits(chosen, [*piece, "key"], ["gm"])
    return last.join(F.broadcast(preset.select("key", "gm")), ["key", "gm"], "left_anti")


def without_pages(pages: DataFrame, edits: DataFrame, page: Sequence[str]) -> DataFrame:
    return pages.join(edits.select(*page).distinct(), [*page], "left_anti")


# ----------------------------------------------------------------- techniques

# The techniques of a note, the kind of value each takes, its choices or its range (``open``: without the
# lowest number itself), and whether null clears it.
TECHNIQUES = [
    ("bend", "number", None, 0.0, 12.0, True, True),
    ("bend_release", "truth", None, None, None, None, False),
    ("slide", "choice", ["shift", "legato", "out_down", "out_up"], None, None, None, True),
    ("slide_in", "choice", ["below", "above"], None, None, None, True),
    ("hopo", "truth", None, None, None, None, False),
    ("harmonic", "choice", list(HARMONICS), None, None, None, True),
    ("harmonic_fret", "number", None, 0.0, 36.0, False, True),
    ("vibrato", "truth", None, None, None, None, False),
    ("palm_mute", "truth", None, None, None, None, False),
    ("staccato", "truth", None, None, None, None, False),
]
RULE = "kind string, takes string, choices array<string>, low double, high double, open boolean, clears boolean"
OCTAVE = 12


def technique_edits(edits: DataFrame, value: str = "value") -> DataFrame:
    """``edits`` (``kind``, and a value as JSON text) with ``num``, ``txt`` and ``flag``, the value in the type that its
    kind takes, and ``reason``: null for a valid edit, else why it is none.

    The rules are a table of ten rows that is joined to the log, so each edit is looked at once."""
    rules = edits.sparkSession.createDataFrame(TECHNIQUES, RULE)
    v = F.try_parse_json(value)
    num, txt, flag = F.try_variant_get("_v", "$", "double"), F.try_variant_get("_v", "$", "string"), F.try_variant_get("_v", "$", "boolean")
    above = F.when(c("open"), num > c("low")).otherwise(num >= c("low"))
    typed = {
        "num": F.when((c("takes") == "number") & is_kind(c("_v"), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), num),
        "txt": F.when((c("takes") == "choice") & is_kind(c("_v"), "STRING"), txt),
        "flag": F.when((c("takes") == "truth") & is_kind(c("_v"), "BOOLEAN"), flag),
    }
    good = (is_kind(c("_v"), "VOID") & c("clears")) | (c("num").isNotNull() & above & (num <= c("high"))) | F.array_contains("choices", c("txt")) | c("flag").isNotNull()
    reason = F.when(c("takes").isNull(), "unknown technique").when(c("_v").isNull(), "not a value").when(~F.coalesce(good, F.lit(False)), "invalid value")
    joined = edits.withColumn("_v", v).join(F.broadcast(rules), "kind", "left").withColumns(typed).withColumn("reason", reason)
    return joined.select(*edits.columns, "num", "txt", "flag", "reason")


def set_techniques(notes: DataFrame, edits: DataFrame, target: Sequence[str]) -> DataFrame:
    """``notes`` (``fret`` and a column per technique) after all valid ``edits`` in order of ``seq``, unique per target.

    The last edit of a kind counts. A harmonic's fret follows both kinds of edits: the last one that fixes it (an edit
    of the fret, or a harmonic that is cleared) counts, and if that leaves none, the first harmonic set after it brings
    its own: the note's fret for a natural one, else the octave. An edit of a note that isn't there changes nothing."""
    key = [*target]
    good = edits.where("reason is null")
    last = good.groupBy(*key, "kind").agg(F.max_by(F.struct("num", "txt", "flag"), "seq").alias("_e"))
    takes = {name: {"number": "num", "choice": "txt", "truth": "flag"}[kind] for name, kind, *_ in TECHNIQUES}
    wide = last.groupBy(*key).agg(*[F.any_value(F.when(c("kind") == k, c("_e")), True).alias(f"_{k}") for k in takes])
    fixes = good.where((c("kind") == "harmonic_fret") | ((c("kind") == "harmonic") & c("txt").isNull()))
    fixed = fixes.groupBy(*key).agg(F.max("seq").alias("_fixed"), F.max_by("num", "seq").alias("_to"))
    later = good.where((c("kind") == "harmonic") & c("txt").isNotNull()).join(fixed.select(*key, "_fixed"), key, "left").where("_fixed is null or seq > _fixed")
    brought = later.groupBy(*key).agg(F.min_by("txt", "seq").alias("_brought"))
    joined = notes.join(wide, key, "left").join(fixed, key, "left").join(brought, key, "left")
    own = F.when(c("_brought") == "natural", c("fret")).when(c("_brought").isNotNull(), OCTAVE).cast("double")
    out = {k: F.when(c(f"_{k}").isNotNull(), c(f"_{k}")[f]).otherwise(c(k)) for k, f in takes.items() if k != "harmonic_fret"}
    out["harmonic_fret"] = F.coalesce(F.when(c("_fixed").isNotNull(), c("_to")).otherwise(c("harmonic_fret")), own)
    return joined.withColumns(out).select(*notes.columns)
