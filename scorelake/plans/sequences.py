"""Sampling, segmentation and windows over the ordered views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import sampling, segments
from scorelake.operators.ordered import (
    cut_columns,
    latest,
    number_islands,
    previous,
    row_number,
    running_sum,
    scan,
    upcoming,
)
from scorelake.plans.registry import register, sql
from scorelake.sources import tables as t

HOUR = 3_600_000_000
DAY = 24 * HOUR


def sampled(spark, d, step):
    return sampling.first_per_cell(t.frames(spark, d), ["vid"], "t_us", step, "event_id")


def sampled_sql(step):
    return f"""sampled as (select * from v_frames qualify row_number() over (
        partition by vid, (t_us + 1) // {step} order by t_us, event_id) = 1)"""


@register("seq1_rate_sampling", sql("v_frames", sampled_sql(12 * HOUR), "select vid, event_id, t_us from sampled"))
def _(spark, d):
    return sampled(spark, d, 12 * HOUR).select("vid", "event_id", "t_us")


@register(
    "seq2_spread_rows",
    sql(
        "v_frames",
        """paced as (select *, case when max(t_us) over (partition by vid) >= 20
            then max(t_us) over (partition by vid) // 20 else 1000000 end step from v_frames)""",
        """firsts as (select * from paced qualify row_number() over (
            partition by vid, (t_us + 1) // step order by t_us, event_id) = 1)""",
        """select vid, event_id, t_us from firsts
           qualify row_number() over (partition by vid order by t_us, event_id) <= 20""",
    ),
)
def _(spark, d):
    return sampling.spread(t.frames(spark, d), ["vid"], "t_us", 20, "event_id").select(
        "vid", "event_id", "t_us"
    )


@register(
    "seq3_row_at_or_after",
    sql(
        "v_frames",
        f"""probes as (select vid, unnest(range(0, 7)) * {5 * DAY} as t_us from
            (select distinct vid from v_frames))""",
        """select p.vid, p.t_us, coalesce(min_by(f.event_id, f.t_us) filter (f.t_us >= p.t_us),
            max_by(f.event_id, f.t_us)) event_id from probes p join v_frames f using (vid)
            group by p.vid, p.t_us""",
    ),
)
def _(spark, d):
    rows = t.frames(spark, d)
    probes = rows.select("vid").distinct().select(
        "vid", F.explode(F.expr(f"transform(sequence(0L, 6L), i -> i * {5 * DAY}L)")).alias("t_us")
    )
    rows = rows.withColumn("event", F.col("event_id")).withColumnRenamed("event_id", "tie")
    found = sampling.at_or_after(
        probes.withColumn("tie", F.lit(0).cast("long")), rows, ["vid"], "t_us", "tie", ["event"]
    )
    return found.select("vid", "t_us", F.col("found.event").alias("event_id"))


def changes(spark, d, delta):
    v = scan(t.vectors(spark, d), "vid", "vec_id", {"before": previous(F.col("embedding"))})
    return v.where(F.col("before").isNotNull()).select(
        "vid",
        "vec_id",
        segments.column_change(F.col("before"), F.col("embedding"), 8, 8, delta).alias("score"),
    )


CHANGES_SQL = """changes as (select vid, vec_id, (select count(*) from (select c from (
        select unnest(range(0, 64)) i, i % 8 c, abs(before[i + 1]::double - embedding[i + 1]::double) m)
        where m > {delta} group by c having count(*) >= 2)) / 8.0 score
    from (select *, lag(embedding) over (partition by vid order by vec_id) before from v_vec)
    where before is not null)"""


@register(
    "seq4_neighbour_change",
    sql(
        "v_vec",
        """pairs as (select vid, vec_id, embedding,
            lag(embedding) over (partition by vid order by vec_id) before from v_vec)""",
        """cells as (select vid, vec_id, i % 8 c, abs(before[i + 1]::double - embedding[i + 1]::double) m
            from pairs, (select unnest(range(0, 64)) i) where before is not null)""",
        "cols as (select vid, vec_id, c, count(*) filter (m > 0.15) n from cells group by all)",
        """select vid, vec_id, count(*) filter (n >= 2) / 8.0::double score from cols
           group by vid, vec_id""",
    ),
)
def _(spark, d):
    return changes(spark, d, 0.15)


@register(
    "seq8_same_content",
    sql(
        "v_vec",
        """pairs as (select vid, vec_id, embedding,
            lag(embedding) over (partition by vid order by vec_id) before from v_vec)""",
        """cells as (select vid, vec_id, i % 8 c, abs(before[i + 1]::double - embedding[i + 1]::double) m
            from pairs, (select unnest(range(0, 64)) i) where before is not null)""",
        "cols as (select vid, vec_id, c, count(*) filter (m > 0.3) n from cells group by all)",
        """select vid, vec_id, count(*) filter (n >= 2) / 8.0::double < 0.05 same from cols
           group by vid, vec_id""",
    ),
)
def _(spark, d):
    return changes(spark, d, 0.3).select("vid", "vec_id", (F.col("score") < 0.05).alias("same"))


@register(
    "seq5_segments",
    sql(
        "v_frames",
        sampled_sql(12 * HOUR),
        """jumps as (select *, case when abs(value - lag(value) over w) < 40 then 0 else 1 end j
            from sampled window w as (partition by vid order by t_us, event_id))""",
        "runs as (select *, sum(j) over (partition by vid order by t_us, event_id) seg from jumps)",
        f"""select vid, cast(seg as bigint) seg, min(t_us) start_us, max(t_us) + {12 * HOUR} end_us,
            count(*) n from runs group by vid, seg
            having max(t_us) + {12 * HOUR} - min(t_us) >= {24 * HOUR}""",
    ),
)
def _(spark, d):
    return segments.stable_segments(
        sampled(spark, d, 12 * HOUR), ["vid"], "t_us", "event_id", "value", 40, 12 * HOUR, 24 * HOUR
    )


@register(
    "seq6_even_picks",
    sql(
        "v_frames",
        sampled_sql(HOUR),
        """marked as (select *, row_number() over w - 1 idx,
            case when abs(value - lag(value) over w) < 150 then 0 else 1 end j
            from sampled window w as (partition by vid order by t_us, event_id))""",
        "runs as (select *, sum(j) over (partition by vid order by t_us, event_id) seg from marked)",
        """ends as (select vid, seg, min(idx) a, max(idx) b, least(count(*), 5) k from runs
            group by vid, seg)""",
        """wanted as (select distinct vid, seg, case when k = 1 then a else
            cast(round_even(a + i * ((b - a) / (k - 1)), 0) as bigint) end idx
            from (select *, unnest(range(0, k)) i from ends))""",
        """select r.vid, cast(r.seg as bigint) seg, r.idx, r.t_us, r.event_id
           from runs r join wanted w on r.vid = w.vid and r.idx = w.idx""",
    ),
)
def _(spark, d):
    rows = sampled(spark, d, HOUR)
    runs = number_islands(
        rows,
        "vid",
        ["t_us", "event_id"],
        lambda p: F.abs(F.col("value") - p["v"]) >= 150,
        {"v": F.col("value")},
        "seg",
        keep=True,
    )
    runs = scan(runs, "vid", ["t_us", "event_id"], {"n": row_number()}).withColumn(
        "idx", F.col("n") - 1
    )
    ends = runs.groupBy("vid", "seg").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    wanted = ends.select(
        "vid", "seg", F.explode(segments.picks(F.col("a"), F.col("b"), 5)).alias("idx")
    )
    return runs.join(wanted, ["vid", "seg", "idx"]).select("vid", "seg", "idx", "t_us", "event_id")


@register(
    "seq7_median_composite",
    sql(
        "v_vec",
        """ranked as (select vid, label, vec_id, embedding,
            row_number() over (partition by vid, label order by vec_id) - 1 idx,
            count(*) over (partition by vid, label) n from v_vec)""",
        """wanted as (select distinct vid, label, case when k = 1 then 0 else
            cast(round_even(i * ((n - 1) / (k - 1)), 0) as bigint) end idx from (
            select *, unnest(range(0, k)) i from (select distinct vid, label, n, least(n, 25) k from ranked)))""",
        """cells as (select r.vid, r.label, r.idx, p, cast(floor(embedding[p + 1]::double * 100) as bigint) g
            from ranked r join wanted using (vid, label, idx), (select unnest(range(0, 64)) p))""",
        """meds as (select vid, label, p, cast(floor(median(g)) as bigint) m, count(*) n
            from cells group by vid, label, p)""",
        """errs as (select vid, label, idx, sum(abs(g - m)) e from cells join meds using (vid, label, p)
            group by vid, label, idx)""",
        "best as (select vid, label, idx from errs qualify row_number() over (partition by vid, label order by e, idx) = 1)",
        """select vid, label, any_value(n) members, string_agg(cast(case when n >= 3 then m else g end as varchar), ','
            order by p) composite from meds join cells using (vid, label, p)
            join best using (vid, label, idx) group by vid, label""",
    ),
)
def _(spark, d):
    v = scan(t.vectors(spark, d), ["vid", "label"], "vec_id", {"n": row_number()})
    v = v.withColumn("idx", F.col("n") - 1).withColumn(
        "vec", F.expr("transform(embedding, e -> floor(cast(e as double) * 100))")
    )
    wanted = v.groupBy("vid", "label").agg(F.max("idx").alias("b")).select(
        "vid", "label", F.explode(segments.picks(F.lit(0).cast("long"), F.col("b"), 25)).alias("idx")
    )
    members = (  # at most 25 to a group
        v.join(wanted, ["vid", "label", "idx"])
        .groupBy("vid", "label")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("m"))
    )
    return members.select(
        "vid",
        "label",
        F.size("m").cast("long").alias("members"),
        F.array_join(segments.median_composite(F.col("m"), 64).cast("array<string>"), ",").alias("composite"),
    )


@register(
    "seq9_merge_adjacent_exact",
    sql(
        "v_frames",
        f"""items as (select *, coalesce(lead(t_us) over w, t_us + {HOUR}) end_us,
            case when event_type = lag(event_type) over w then 0 else 1 end j
            from v_frames window w as (partition by vid order by t_us, event_id))""",
        "runs as (select *, sum(j) over (partition by vid order by t_us, event_id) run from items)",
        """grown as (select *, min(t_us) over (partition by vid, run) run_us,
            lag(end_us) over (partition by vid, run order by t_us, event_id) before_us from runs)""",
        """select vid, cast(run as bigint) run, min(t_us) start_us, max(end_us) end_us, count(*) n,
            max_by(event_id, t_us) filter (before_us is null or end_us - t_us > before_us - run_us) kept
            from grown group by vid, run""",
    ),
)
def _(spark, d):
    from scorelake.operators.ordered import following

    order = ["t_us", "event_id"]
    items = scan(t.frames(spark, d), "vid", order, {"next_us": following(F.col("t_us"))}, keep=True)
    items = items.withColumn("end_us", F.coalesce("next_us", F.col("t_us") + HOUR))
    runs = number_islands(
        items, "vid", order, lambda p: F.col("event_type") != p["e"],
        {"e": F.col("event_type")}, "run", keep=True,
    )
    # the kept item changes when a later one outlives everything merged before it
    runs = scan(runs, "vid", order, {"before": previous(F.struct("run", "end_us"))}, keep=True)
    runs = runs.withColumn("first_us", F.when(F.coalesce(F.col("before.run"), F.lit(0)) != F.col("run"), F.col("t_us")))
    runs = scan(runs, "vid", order, {"run_us": latest(F.col("first_us"))})
    takes = F.col("first_us").isNotNull() | (
        F.col("end_us") - F.col("t_us") > F.col("before.end_us") - F.col("run_us")
    )
    return runs.groupBy("vid", "run").agg(
        F.min("t_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.count("*").alias("n"),
        F.max_by(F.col("event_id"), F.when(takes, F.col("t_us"))).alias("kept"),
    )


PLACES_SQL = "places as (select distinct frame, x0 from v_boxes)"


@register(
    "seq10_bar_runs",
    sql(
        "v_boxes",
        PLACES_SQL,
        """select frame, x0 bar from places
           qualify coalesce(x0 - lag(x0) over (partition by frame order by x0) > 12, true)""",
    ),
)
def _(spark, d):
    runs = segments.pixel_runs(t.boxes(spark, d), ["frame"], "x0", 12)
    return runs.groupBy("frame", "run").agg(F.min("x0").alias("bar")).select("frame", "bar")


@register(
    "seq11_longest_run",
    sql(
        "v_boxes",
        PLACES_SQL,
        """jumps as (select *, case when x0 - lag(x0) over (partition by frame order by x0) <= 41
            then 0 else 1 end j from places)""",
        "runs as (select *, sum(j) over (partition by frame order by x0) run from jumps)",
        "sized as (select frame, min(x0) a, max(x0) z from runs group by frame, run)",
        """select frame, a, z + 1 b from sized
           qualify row_number() over (partition by frame order by z - a desc, a) = 1""",
    ),
)
def _(spark, d):
    return segments.longest_run(t.boxes(spark, d), ["frame"], "x0", 40)


SPANS_SQL = """spans as (select piece, pos, case when linenumber <> 7 then qty % 3 * 12 end a,
    case when linenumber <> 7 then qty % 3 * 12 + 30 + fret % 5 end b from v_notes)"""
PERIODS_SQL = (
    SPANS_SQL,
    """laps as (select *, lag(b) over w before_b, least(b, lag(b) over w) - greatest(a, lag(a) over w) ov,
        least(b - a, lag(b - a) over w) sh from spans where a is not null
        window w as (partition by piece order by pos))""",
    """pieces as (select *, sum(case when before_b is not null and ov * 10 > sh * 6 then 0 else 1 end)
        over (partition by piece order by pos) period from laps)""",
    """wide as (select *, (b - a) * 10 >= max(b - a) over (partition by piece, period) * 9 wide
        from pieces)""",
    """periods as (select piece, cast(period as bigint) period,
        cast(floor(median(a) filter (wide)) as bigint) x0,
        cast(floor(median(b) filter (wide)) as bigint) x1, min(pos) start_t, max(pos) end_t
        from wide group by piece, period)""",
)


def highlight_spans(spark, d):
    n = t.notes(spark, d)
    return n.select(
        *cut_columns(n),
        "piece",
        "pos",
        F.expr("case when linenumber <> 7 then qty % 3 * 12 end").alias("a"),
        F.expr("case when linenumber <> 7 then qty % 3 * 12 + 30 + fret % 5 end").alias("b"),
    )


@register("seq12_highlight_periods", sql("v_notes", *PERIODS_SQL, "select * from periods"))
def _(spark, d):
    return segments.highlight_periods(highlight_spans(spark, d), ["piece"], "pos", "pos", "a", "b")


@register(
    "seq13_measure_spans",
    sql(
        "v_boxes",
        PLACES_SQL,
        """spans as (select frame, x0 a, coalesce(lead(x0) over (partition by frame order by x0), 500) b
            from places union all select frame, 0, min(x0) from places group by frame having min(x0) > 20)""",
        "select frame, a, b from spans where b - a >= 15",
    ),
)
def _(spark, d):
    return segments.edge_spans(t.boxes(spark, d), ["frame"], "x0", 500, 20, 15)


@register(
    "seq14_overlap_strips",
    sql(
        "v_notes",
        """links as (select piece, pos, lag(50 + fret) over w moved,
            lag(pos) over w is null or conf < 0.035 starts
            from v_notes window w as (partition by piece order by pos))""",
        """strips as (select *, sum(case when starts then 1 else 0 end)
            over (partition by piece order by pos) strip from links)""",
        """select piece, pos, cast(strip as bigint) strip, cast(coalesce(sum(case when starts then 0 else moved end)
            over (partition by piece, strip order by pos), 0) as bigint) x from strips""",
    ),
)
def _(spark, d):
    pages = t.notes(spark, d)
    return segments.overlap_strips(
        pages, ["piece"], ["pos"], F.col("fret") + 50, F.col("conf") >= 0.035
    ).select("piece", "pos", "strip", "x")


@register(
    "seq15_fixed_cuts",
    sql(
        "v_frames",
        f"""widths as (select vid, max(t_us) // {HOUR} width from v_frames group by vid)""",
        """select vid, x a, least(x + 100, width) b from
           (select vid, width, unnest(range(0, width, 100)) x from widths)""",
    ),
)
def _(spark, d):
    widths = t.frames(spark, d).groupBy("vid").agg(F.expr(f"max(t_us) div {HOUR}").alias("width"))
    return widths.select(
        "vid", "width", F.explode(segments.cuts(F.col("width"), 100)).alias("a")
    ).select("vid", "a", F.least(F.col("a") + 100, F.col("width")).alias("b"))


@register(
    "seq20_joined_digits",
    sql(
        "v_boxes",
        """glyphs as (select frame, line_, item % 40 x, min(supp % 7 + 3) w, min(item) % 10 digit
            from v_boxes group by all)""",
        """jumps as (select *, case when x - lag(x + w) over (partition by frame, line_ order by x)
            between -1 and 3 then 0 else 1 end j from glyphs)""",
        "runs as (select *, sum(j) over (partition by frame, line_ order by x) run from jumps)",
        """select frame, line_, min(x) x, cast(string_agg(cast(digit as varchar), '' order by x) as bigint) number
           from runs group by frame, line_, run""",
    ),
)
def _(spark, d):
    glyphs = (  # one glyph per pixel column of a row
        t.boxes(spark, d)
        .groupBy("frame", "line_", F.expr("item % 40").alias("x"))
        .agg(F.expr("min(supp % 7 + 3)").alias("w"), F.expr("min(item) % 10").alias("digit"))
    )
    w = Window.partitionBy("frame", "line_").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    runs = glyphs.withColumn("j", F.when(gap.between(-1, 3), 0).otherwise(1)).withColumn(
        "run", F.sum("j").over(w)
    )
    return runs.groupBy("frame", "line_", "run").agg(
        F.min("x").alias("x"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("x", "digit"))), lambda g: g["digit"].cast("string")), ""
        ).cast("long").alias("number"),
    ).drop("run")


@register(
    "seq21_dash_extents",
    sql(
        "v_boxes",
        """marks as (select frame, x0 x, min(x1) r, min(line_) row_, bool_or(item % 7 = 0) tick
            from v_boxes group by frame, x0)""",
        """steps as (select *, first_value(row_) over w row0, row_ <> first_value(row_) over w
            or x - lag(r) over w > 60 or coalesce(lag(tick) over w, false) stop
            from marks window w as (partition by frame order by x))""",
        """alive as (select *, max(case when stop then 1 else 0 end) over (partition by frame order by x) dead
            from steps)""",
        "select frame, max(r) end_x, count(*) used from alive where dead = 0 group by frame",
    ),
)
def _(spark, d):
    marks = t.boxes(spark, d).groupBy("frame", F.col("x0").alias("x")).agg(
        F.min("x1").alias("r"), F.min("line_").alias("row_"), F.expr("bool_or(item % 7 = 0)").alias("tick")
    )
    w = Window.partitionBy("frame").orderBy("x")  # one mark per pixel column
    stop = (
        (F.col("row_") != F.first("row_").over(w))
        | F.coalesce(F.col("x") - F.lag("r").over(w) > 60, F.lit(False))
        | F.coalesce(F.lag("tick").over(w), F.lit(False))
    )
    alive = marks.withColumn("stop", stop.cast("int")).withColumn("dead", F.max("stop").over(w))
    return alive.where("dead = 0").groupBy("frame").agg(
        F.max("r").alias("end_x"), F.count("*").alias("used")
    )


@register(
    "seq22_reach",
    sql(
        "v_boxes",
        PLACES_SQL,
        """jumps as (select *, case when x0 - lag(x0) over (partition by frame order by x0) <= 61
            then 0 else 1 end j from places where x0 < 350)""",
        "runs as (select *, sum(j) over (partition by frame order by x0) run from jumps)",
        """select frame, max(x0) last_x, max(x0) + 61 >= 350 open_ from runs where run = 1
           group by frame""",
    ),
)
def _(spark, d):
    return segments.reach(t.boxes(spark, d), ["frame"], "x0", 60, 350)


# ------------------------------------------------------------------------- windows


@register(
    "win1_neighbour_change",
    sql(
        "v_frames",
        """select vid, event_id, t_us - lag(t_us) over w dt,
            abs(value - lag(value) over w) >= 40 changed
            from v_frames window w as (partition by vid order by t_us, event_id)""",
    ),
)
def _(spark, d):
    near = scan(
        t.frames(spark, d), "vid", ["t_us", "event_id"], {"p": previous(F.struct("t_us", "value"))}
    )
    return near.select(
        "vid",
        "event_id",
        (F.col("t_us") - F.col("p.t_us")).alias("dt"),
        (F.abs(F.col("value") - F.col("p.value")) >= 40).alias("changed"),
    )


@register(
    "win2_next_onset",
    sql(
        "v_notes",
        "placed as (select piece, measure, pos, fret % 4 * 20160 onset from v_notes)",
        """select piece, measure, pos, onset, coalesce(min(onset) over (partition by piece, measure
            order by onset range between 1 following and unbounded following), 80640) next_onset from placed""",
    ),
)
def _(spark, d):
    placed = t.notes(spark, d).select("piece", "measure", "pos", F.expr("fret % 4 * 20160").alias("onset"))
    w = Window.partitionBy("piece", "measure").orderBy("onset")  # four notes to a measure
    nxt = F.min("onset").over(w.rangeBetween(1, Window.unboundedFollowing))
    return placed.withColumn("next_onset", F.coalesce(nxt, F.lit(80640).cast("long")))


@register(
    "win4_held_notes",
    sql(
        "v_notes",
        """shown as (select *, partkey % 5 = 0 hidden, case when partkey % 5 <> 0 then fret end f,
            case when partkey % 5 <> 0 then string_ end s from v_notes)""",
        """select piece, pos, last_value(s ignore nulls) over w string_, last_value(f ignore nulls) over w fret,
            case when hidden then last_value(f ignore nulls) over w is not null else tied end tied,
            case when hidden then 0.5 else conf end conf from shown
            window w as (partition by piece order by pos)""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d).withColumn("hidden", F.expr("partkey % 5 = 0"))
    n = n.withColumn("own", F.when(~F.col("hidden"), F.struct("string_", "fret")))
    held = scan(n, "piece", "pos", {"last": latest(F.col("own"))})
    return held.select(
        "piece",
        "pos",
        F.col("last.string_").alias("string_"),
        F.col("last.fret").alias("fret"),
        F.when(F.col("hidden"), F.col("last").isNotNull()).otherwise(F.col("tied")).alias("tied"),
        F.when(F.col("hidden"), F.lit(0.5)).otherwise(F.col("conf")).alias("conf"),
    )


@register(
    "win6_key_in_force",
    sql(
        "v_systems",
        """select piece, seq, last_value(fifths ignore nulls) over (partition by piece order by seq) key_
           from v_systems""",
    ),
)
def _(spark, d):
    return scan(t.systems(spark, d), "piece", "seq", {"key_": latest(F.col("fifths"))}).select(
        "piece", "seq", "key_"
    )


@register(
    "win7_strictly_increasing",
    sql(
        "v_notes",
        """steps as (select piece, linenumber - lag(linenumber) over (partition by piece order by pos) step_
            from v_notes)""",
        "select piece, coalesce(bool_and(step_ > 0), true) increasing from steps group by piece",
    ),
)
def _(spark, d):
    steps = scan(t.notes(spark, d), "piece", "pos", {"before": previous(F.col("linenumber"))})
    return steps.groupBy("piece").agg(
        F.coalesce(F.bool_and(F.col("linenumber") > F.col("before")), F.lit(True)).alias("increasing")
    )


@register(
    "win8_renumber",
    sql("v_systems", "select piece, seq, row_number() over (partition by piece order by seq) number from v_systems"),
)
def _(spark, d):
    return scan(t.systems(spark, d), "piece", "seq", {"number": row_number()}).select(
        "piece", "seq", "number"
    )


@register(
    "win9_changed_attributes",
    sql(
        "v_systems",
        """seen as (select piece, seq, attr, chars % 3 val, row_number() over w n, lag(chars % 3) over w before
            from v_systems window w as (partition by piece, attr order by seq))""",
        """select piece, seq, attr, val from seen where case when attr = 'system' then n = 1
           else val is distinct from before end""",
    ),
)
def _(spark, d):
    from scorelake.operators.numbering import changed_attributes

    rows = t.systems(spark, d).select("piece", "seq", "attr", F.expr("chars % 3").alias("val"))
    return changed_attributes(rows, ["piece", "attr"], ["seq"], "val", F.col("attr") == "system")


@register(
    "win10_measure_starts",
    sql(
        "v_notes",
        "bars as (select distinct piece, measure, 80640 // 4 * (3 + measure % 2) cap from v_notes)",
        """select piece, measure, cap, cast(coalesce(sum(cap) over (partition by piece order by measure
            rows between unbounded preceding and 1 preceding), 0) as bigint) start_tick from bars""",
    ),
)
def _(spark, d):
    bars = t.notes(spark, d).select(
        "piece", "measure", F.expr("80640 div 4 * (3 + measure % 2)").alias("cap")
    ).distinct()
    return scan(bars, "piece", "measure", {"start_tick": running_sum(F.col("cap"), False)})


@register(
    "win11_delta_time",
    sql(
        "v_notes",
        "ticks as (select piece, pos, measure * 1920 + fret % 4 * 480 tick, partkey % 3 ord from v_notes)",
        """select piece, pos, tick, ord, tick - coalesce(lag(tick) over (partition by piece
            order by tick, ord, pos), 0) delta from ticks""",
    ),
)
def _(spark, d):
    ticks = t.notes(spark, d).select(
        "piece", "pos", F.expr("measure * 1920 + fret % 4 * 480").alias("tick"),
        F.expr("partkey % 3").alias("ord"),
    )
    near = scan(ticks, "piece", ["tick", "ord", "pos"], {"p": previous(F.col("tick"))})
    return near.select(
        "piece", "pos", "tick", "ord", (F.col("tick") - F.coalesce("p", F.lit(0))).alias("delta")
    )


@register(
    "win15_next_flagged",
    sql(
        "v_notes",
        "flags as (select piece, pos, case when conf < 0.03 then pos end f from v_notes)",
        """select piece, pos, coalesce(min(f) over (partition by piece order by pos
            rows between 1 following and unbounded following), min(f) over (partition by piece)) next_pos
            from flags""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d).withColumn("f", F.expr("case when conf < 0.03 then pos end"))
    firsts = n.groupBy("piece").agg(F.min("f").alias("wrap"))
    ahead = scan(n, "piece", "pos", {"ahead": upcoming(F.col("f"), inclusive=False)})
    return ahead.join(firsts, "piece").select(
        "piece", "pos", F.coalesce("ahead", "wrap").alias("next_pos")
    )
