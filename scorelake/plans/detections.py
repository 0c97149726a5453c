"""Boxes, interval joins and nearest rules over detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions import boxes as bx
from scorelake.operators import intervals as iv
from scorelake.operators import sampling, segments
from scorelake.operators.ordered import previous, row_number, running_sum, scan
from scorelake.plans.registry import register, sql
from scorelake.plans.sequences import PERIODS_SQL, highlight_spans
from scorelake.session import checkpoint_folder
from scorelake.sources import tables as t


@register(
    "prj1_clamp_box",
    sql(
        "v_boxes",
        """raw as (select frame, item, supp, x0 - 20 x, supp % 100 - 10 y, (x1 - x0) * 3 w, supp % 50 h from v_boxes)""",
        "moved as (select *, least(greatest(x, 0), 299) cx, least(greatest(y, 0), 79) cy from raw)",
        """select frame, item, supp, cx x, cy y, greatest(1, least(w, 300 - cx)) w,
           greatest(1, least(h, 80 - cy)) h from moved""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    box = bx.clamp(
        F.col("x0") - 20, F.expr("supp % 100 - 10"), (F.col("x1") - F.col("x0")) * 3,
        F.expr("supp % 50"), 300, 80,
    )
    return b.select("frame", "item", "supp", box.alias("b")).select("frame", "item", "supp", "b.*")


@register(
    "prj2_box_iou",
    sql(
        "v_boxes",
        """two as (select frame, item, supp, x0 ax, x1 - x0 aw, line_ * 5 ay, 10 ah,
            supp * 4 bx, 40 bw, supp % 40 b_y, 20 bh from v_boxes)""",
        """parts as (select *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx))
            * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) i from two)""",
        """select frame, item, supp, case when aw * ah + bw * bh - i = 0 then 0.0::double
           else i::double / (aw * ah + bw * bh - i) end iou from parts""",
    ),
)
def _(spark, d):
    def box(x, y, w, h):
        return F.struct(*[F.expr(e).alias(n) for e, n in zip((x, y, w, h), "xywh")])

    a, b = box("x0", "line_ * 5", "x1 - x0", "10L"), box("supp * 4", "supp % 40", "40L", "20L")
    two = t.boxes(spark, d).select("frame", "item", "supp", a.alias("a"), b.alias("b"))
    return two.select("frame", "item", "supp", bx.iou(F.col("a"), F.col("b")).alias("iou"))


BBOX_SQL = """(select frame, max(1 + supp % 3) s, median(x0) m0, median(x1) m1, min(line_ * 10) t0,
    max(line_ * 10 + 8) b0 from v_boxes group by frame)"""


@register(
    "prj3_box_around_all",
    sql(
        "v_boxes",
        f"""ends as (select frame, greatest(0, cast(trunc(m0 - s) as bigint)) x0, greatest(0, t0 - 3 * s) y0,
            least(420, cast(trunc(m1 + s) as bigint)) x1, least(75, b0 + 3 * s) y1 from {BBOX_SQL})""",
        "select frame, x0 x, y0 y, x1 - x0 w, y1 - y0 h from ends",
    ),
)
def _(spark, d):
    from scorelake.operators.regions import box_around

    b = t.boxes(spark, d).select(
        "frame", "x0", "x1", F.expr("line_ * 10").alias("top"),
        F.expr("line_ * 10 + 8").alias("bottom"), F.expr("1 + supp % 3").alias("s"),
    )
    return box_around(b, ["frame"], 420, 75)


@register(
    "prj4_trim_to_panel",
    sql(
        "v_vec",
        "cells as (select vec_id, i // 8 r, cast(floor(embedding[i + 1]::double * 100) as bigint) g from v_vec, (select unnest(range(0, 64)) i))",
        "bg as (select vec_id, median(g) m from cells group by vec_id)",
        "rows_ as (select vec_id, r, avg(case when abs(g - m) < 12 then 1.0::double else 0 end) share from cells join bg using (vec_id) group by vec_id, r)",
        """select vec_id, coalesce(min(r) filter (share >= 0.6), 0) top, coalesce(max(r) filter (share >= 0.6), 7) bottom
           from rows_ group by vec_id""",
    ),
)
def _(spark, d):
    from scorelake.operators.regions import panel_rows

    v = t.vectors(spark, d).select(
        "vec_id", F.expr("transform(embedding, e -> floor(cast(e as double) * 100))").alias("g")
    )
    ends = panel_rows(F.col("g"), 8, 8, 12, 0.6)
    return v.select("vec_id", ends.alias("e")).select("vec_id", "e.top", "e.bottom")


@register(
    "prj5_pages_with_detections",
    sql("", "select p_partkey, p_name from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)"),
)
def _(spark, d):
    hits = t.table(spark, d, "lineitem").where("l_quantity > 49").select(
        F.col("l_partkey").alias("p_partkey")
    )
    return t.table(spark, d, "part").select("p_partkey", "p_name").join(
        hits.distinct(), "p_partkey", "left_semi"
    )


# --------------------------------------------------------------------------- joins


@register(
    "jn1_lookup_in_order",
    sql(
        "v_notes",
        """select n.piece, n.pos, p_name name from v_notes n join part on p_partkey = n.partkey * 2""",
    ),
)
def _(spark, d):
    wanted = t.notes(spark, d).select("piece", "pos", (F.col("partkey") * 2).alias("p_partkey"))
    known = t.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return wanted.join(known, "p_partkey").select("piece", "pos", "name")


@register(
    "jn2_unknown_ids",
    sql(
        "v_boxes",
        """select frame, count(distinct item) unknown from v_boxes
           where not exists (select 1 from part where p_partkey = item + 100) group by frame""",
    ),
)
def _(spark, d):
    ids = t.boxes(spark, d).select("frame", "item").distinct()
    known = t.table(spark, d, "part").select((F.col("p_partkey") - 100).alias("item"))
    return ids.join(known, "item", "left_anti").groupBy("frame").agg(F.count("*").alias("unknown"))


MEASURE_SPANS_SQL = (
    "places as (select distinct frame, x0 from v_boxes)",
    """all_spans as (select frame, x0 a, coalesce(lead(x0) over (partition by frame order by x0), 500) b
        from places union all select frame, 0, min(x0) from places group by frame having min(x0) > 20)""",
    "spans as (select frame, a, b from all_spans where b - a >= 15)",
)


def measure_spans(spark, d):
    return segments.edge_spans(t.boxes(spark, d), ["frame"], "x0", 500, 20, 15)


@register(
    "jn3_covered_spans",
    sql(
        "v_boxes",
        *MEASURE_SPANS_SQL,
        "cut as (select frame, unnest(range(0, 500, 120)) c0 from (select distinct frame from places))",
        """select frame, c0, min(a) start_, max(b) end_ from cut join spans using (frame)
           where a < least(c0 + 120, 500) and b > c0 group by frame, c0""",
    ),
)
def _(spark, d):
    spans = measure_spans(spark, d)
    cut = spans.select("frame").distinct().select(
        "frame", F.explode(segments.cuts(F.lit(500).cast("long"), 120)).alias("c0")
    ).withColumn("c1", F.least(F.col("c0") + 120, F.lit(500)))
    pairs = iv.overlap_join(cut, spans, ["frame"], ("c0", "c1"), ("a", "b"), 120)
    return pairs.groupBy("frame", "c0").agg(F.min("a").alias("start_"), F.max("b").alias("end_"))


@register(
    "jn4_points_in_intervals",
    sql(
        "v_boxes",
        *MEASURE_SPANS_SQL,
        "points as (select frame, (x0 + x1) // 2 x, count(*) n from v_boxes group by all)",
        """select frame, a, b, cast(sum(n) as bigint) n from spans join points using (frame)
           where a < x and x < b group by frame, a, b""",
    ),
)
def _(spark, d):
    points = t.boxes(spark, d).groupBy("frame", F.expr("(x0 + x1) div 2").alias("x")).agg(
        F.count("*").alias("n")
    )
    spans = measure_spans(spark, d)
    pairs = iv.overlap_join(
        points.withColumn("x_", F.col("x")), spans, ["frame"], ("x", "x_"), ("a", "b"), 64
    )
    return pairs.groupBy("frame", "a", "b").agg(F.sum("n").alias("n"))


@register(
    "jn5_most_overlapped",
    sql(
        "v_boxes",
        *MEASURE_SPANS_SQL,
        "numbered as (select *, row_number() over (partition by frame order by a) number from spans where b - a >= 25)",
        "kinds as (select distinct frame, x0, x1 from v_boxes)",
        """best as (select frame, x0, x1, max_by(number, least(x1, b) - greatest(x0, a) - number / 1000000.0) number
            from kinds join numbered using (frame) where x0 < b and x1 > a group by all)""",
        "select k.frame, k.x0, k.x1, number from kinds k left join best using (frame, x0, x1)",
    ),
)
def _(spark, d):
    w = Window.partitionBy("frame").orderBy("a")  # distinct pixel edges
    numbered = measure_spans(spark, d).where("b - a >= 25").withColumn(
        "number", F.row_number().over(w).cast("long")
    )
    kinds = t.boxes(spark, d).select("frame", "x0", "x1").distinct()
    return iv.best_overlap(kinds, numbered, ["frame"], "number", 64)


@register(
    "jn6_nearest_with_tolerance",
    sql(
        "v_boxes",
        "lines_ as (select distinct frame, x0 y from v_boxes)",
        "probes as (select distinct frame, x1 x from v_boxes)",
        "found as (select frame, x, min_by(y, abs(x - y) * 1000 + y) y from probes join lines_ using (frame) group by all)",
        "select frame, x, case when abs(x - y) <= 25 then y end line_y from found",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    zero = F.lit(0).cast("long")
    rows = b.select("frame", F.col("x0").alias("x")).distinct().withColumn("tie", zero)
    probes = b.select("frame", F.col("x1").alias("x")).distinct().withColumn("tie", zero)
    near = sampling.nearest(probes, rows, ["frame"], "x", "tie", [])
    close = F.abs(F.col("found.x") - F.col("x")) <= 25
    return near.select("frame", "x", F.when(close, F.col("found.x")).alias("line_y"))


def bars_of(spark, d):
    return t.boxes(spark, d).select("frame", F.col("x0").alias("x")).distinct()


@register(
    "jn7_snap_to_bars",
    sql(
        "v_boxes",
        "bars as (select distinct frame, x0 x from v_boxes)",
        "kinds as (select distinct frame, x0 + supp % 9 - 4 x0, x1 + 10 x1 from v_boxes)",
        """ends as (select k.frame, k.x0, k.x1,
            max(x) filter (x between k.x0 - 10 and k.x0 + 6) l,
            min(x) filter (x between k.x1 - 6 and k.x1 + 10 and x > k.x0 + 20) r
            from kinds k join bars b using (frame) group by all)""",
        """select frame, x0, x1, coalesce(l, x0) left_x, coalesce(r, x1) right_x,
           l is not null and r is not null whole from ends""",
    ),
)
def _(spark, d):
    spans = t.boxes(spark, d).select(
        "frame", F.expr("x0 + supp % 9 - 4").alias("x0"), (F.col("x1") + 10).alias("x1")
    )
    return iv.snap(spans, bars_of(spark, d), ["frame"], 10)


STRING_NOTES_SQL = """fr as (select frame, supp % 6 string_, x0 x, min(item % 25) fret,
    bool_or(item % 9 = 0) tied, bool_or(item % 10 = 0) dead from v_boxes group by all)"""
PAIRS_SQL = """prs as (select frame, string_, x ax, fret afret, tied, dead, lead(x) over w bx, lead(fret) over w bfret,
    lead(tied) over w btied, lead(dead) over w bdead from fr window w as (partition by frame, string_ order by x))"""


def string_notes(spark, d):
    return t.boxes(spark, d).groupBy(
        "frame", F.expr("supp % 6").alias("string_"), F.col("x0").alias("x")
    ).agg(
        F.expr("min(item % 25)").alias("fret"),
        F.expr("bool_or(item % 9 = 0)").alias("tied"),
        F.expr("bool_or(item % 10 = 0)").alias("dead"),
    )


@register(
    "jn11_pair_around",
    sql(
        "v_boxes",
        STRING_NOTES_SQL,
        PAIRS_SQL,
        "marks as (select distinct frame, x1 x from v_boxes)",
        """hits as (select frame, x, string_, ax, bx from marks join prs using (frame)
            where ax < x and x < bx and bx - ax <= 120)""",
        """select frame, x, string_, ax, bx from hits
           qualify row_number() over (partition by frame, x order by bx - ax, string_ desc) = 1""",
    ),
)
def _(spark, d):
    pairs = iv.consecutive(string_notes(spark, d), ["frame", "string_"], "x", []).select(
        "frame", "string_", F.col("x").alias("ax"), F.col("next.x").alias("bx")
    ).where("bx - ax <= 120")
    marks = t.boxes(spark, d).select("frame", F.col("x1").alias("x")).distinct()
    hits = iv.overlap_join(
        marks.withColumn("x_", F.col("x")), pairs, ["frame"], ("x", "x_"), ("ax", "bx"), 64
    )
    best = F.min_by(F.struct("string_", "ax", "bx"), F.struct(F.col("bx") - F.col("ax"), -F.col("string_")))
    return hits.groupBy("frame", "x").agg(best.alias("p")).select("frame", "x", "p.*")


@register(
    "jn12_arcs_to_pairs",
    sql(
        "v_boxes",
        STRING_NOTES_SQL,
        PAIRS_SQL,
        "arcs as (select distinct frame, x0 + supp % 7 - 3 x, x0 + qty_ + 40 r from (select *, x1 - x0 qty_ from v_boxes))",
        """select distinct frame, string_, ax x from prs where afret <> bfret and not btied and not dead and not bdead
           and exists (select 1 from arcs a where a.frame = prs.frame and abs(a.x - ax) <= 8 and abs(a.r - bx) <= 8)""",
    ),
)
def _(spark, d):
    notes = string_notes(spark, d)
    pairs = iv.consecutive(notes, ["frame", "string_"], "x", ["fret", "tied", "dead"]).where(
        "fret <> next.fret and not next.tied and not dead and not next.dead"
    ).select("frame", "string_", F.col("x").alias("ax"), F.col("next.x").alias("bx"))
    arcs = t.boxes(spark, d).select(
        "frame", F.expr("x0 + supp % 7 - 3").alias("x"), F.expr("x1 + 40").alias("r")
    ).distinct()
    near = iv.within(pairs, arcs, ["frame"], F.col("ax") - 8, F.col("ax") + 8, "x", 17)
    return near.where(F.abs(F.col("r") - F.col("bx")) <= 8).select(
        "frame", "string_", F.col("ax").alias("x")
    ).distinct()


@register(
    "jn13_diagonal_slides",
    sql(
        "v_boxes",
        "fr as (select distinct frame, supp % 6 string_, x0 l, x0 + 10 r from v_boxes)",
        "dg as (select distinct frame, item % 6 string_, x0 + 12 x, x0 + 24 e, supp % 2 = 0 down_ from v_boxes)",
        """near as (select g.frame, g.string_, g.x, g.down_, max(f.l) filter (g.x - f.r between -2 and 16) a,
            min(f.l) filter (f.l - g.e between -2 and 16) z from dg g left join fr f using (frame, string_) group by all)""",
        """select frame, string_, x, down_, case when a is not null and z is not null then
             case when (z - a) % 2 = 0 then 'legato' else 'shift' end
           when z is not null then case when down_ then 'in_above' else 'in_below' end
           when a is not null then case when down_ then 'out_down' else 'out_up' end end kind from near""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    notes = b.select("frame", F.expr("supp % 6").alias("string_"), F.col("x0").alias("l")).distinct()
    marks = b.select(
        "frame", F.expr("item % 6").alias("string_"), F.expr("x0 + 12").alias("x"),
        F.expr("supp % 2 = 0").alias("down_"),
    ).distinct()
    keys = ["frame", "string_"]
    x = F.col("x")
    left = iv.within(marks, notes, keys, x - 26, x - 8, "l", 19).groupBy(*keys, "x", "down_").agg(F.max("l").alias("a"))
    right = iv.within(marks, notes, keys, x + 10, x + 28, "l", 19).groupBy(*keys, "x", "down_").agg(F.min("l").alias("z"))
    near = marks.join(left, [*keys, "x", "down_"], "left").join(right, [*keys, "x", "down_"], "left")
    kind = F.expr(
        """case when a is not null and z is not null then
             case when (z - a) % 2 = 0 then 'legato' else 'shift' end
           when z is not null then case when down_ then 'in_above' else 'in_below' end
           when a is not null then case when down_ then 'out_down' else 'out_up' end end"""
    )
    return near.select("frame", "string_", "x", "down_", kind.alias("kind"))


@register(
    "jn14_groups_in_extents",
    sql(
        "v_boxes",
        "points as (select distinct frame, x0 x from v_boxes)",
        "ext as (select distinct frame, x1 - 3 lo, x1 + 35 hi from v_boxes)",
        """select frame, x, exists (select 1 from ext e where e.frame = p.frame and x between lo and hi) inside
           from points p""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    points = b.select("frame", F.col("x0").alias("x")).distinct().withColumn("tie", F.lit(0).cast("long"))
    ext = b.select(
        "frame", F.expr("x1 - 3").alias("lo"), F.expr("x1 + 35").alias("hi")
    ).distinct()
    return iv.inside_any(points, ext, ["frame"], "x", "tie").drop("tie")


@register(
    "jn15_bracketed_numbers",
    sql(
        "v_boxes",
        "o as (select distinct frame, supp % 4 row_, x0 ox from v_boxes)",
        "c as (select distinct frame, supp % 4 row_, x1 cx from v_boxes)",
        "br as (select frame, row_, ox, min(cx) cx from o join c using (frame, row_) where cx - ox between 1 and 30 group by all)",
        "n as (select frame, supp % 4 row_, x0 + 8 x, max(x1 - x0) h from v_boxes group by all)",
        """select frame, row_, ox, cx, count(x) inside, case when count(*) filter (h >= 28) > 0 then 'natural'
           when count(x) > 0 then 'artificial' end kind
           from br left join n on n.frame = br.frame and n.row_ = br.row_ and ox < x and x < cx
           group by br.frame, br.row_, ox, cx""".replace("select frame, row_", "select br.frame, br.row_"),
    ),
)
def _(spark, d):
    b = t.boxes(spark, d).withColumn("row_", F.expr("supp % 4"))
    keys = ["frame", "row_"]
    opens = b.select(*keys, F.col("x0").alias("ox")).distinct()
    closes = b.select(*keys, F.col("x1").alias("cx")).distinct()
    ox = F.col("ox")
    pairs = iv.within(opens, closes, keys, ox + 1, ox + 30, "cx", 30).groupBy(*keys, "ox").agg(F.min("cx").alias("cx"))
    numbers = b.groupBy(*keys, F.expr("x0 + 8").alias("x")).agg(F.expr("max(x1 - x0)").alias("h"))
    inside = iv.within(pairs.where("cx - ox > 1"), numbers, keys, ox + 1, F.col("cx") - 1, "x", 30).groupBy(*keys, "ox").agg(
        F.count("*").alias("inside"), F.max("h").alias("h")
    )
    found = pairs.join(inside, [*keys, "ox"], "left")
    kind = F.when(F.col("h") >= 28, "natural").when(F.col("inside") > 0, "artificial")
    return found.select(*keys, "ox", "cx", F.coalesce("inside", F.lit(0)).alias("inside"), kind.alias("kind"))


@register(
    "jn16_support_count",
    sql(
        "v_boxes",
        "staves as (select distinct frame // 20 vid, frame, x0 a, x1 b from v_boxes)",
        "kinds as (select distinct vid, a, b from staves)",
        """select k.vid, k.a, k.b, count(distinct s.frame) frames from kinds k join staves s
           on s.vid = k.vid and s.a <= k.b and k.a <= s.b group by all""",
    ),
)
def _(spark, d):
    staves = t.boxes(spark, d).select(
        F.expr("frame div 20").alias("vid"), "frame", F.col("x0").alias("a"), F.col("x1").alias("b")
    )
    return iv.support(staves, ["vid"], "frame", "a", "b")


@register(
    "jn17_consecutive_pairs",
    sql(
        "v_notes",
        """links as (select piece, pos, coalesce(abs(qty % 4 - lead(qty % 4) over w) <= 1
            and lead(fret) over w between 2 and 18, false) link from v_notes
            window w as (partition by piece order by pos))""",
        """runs as (select *, sum(case when link then 0 else 1 end) over (partition by piece order by pos) run
            from links)""",
        """steps as (select *, row_number() over (partition by piece, run, link order by pos) n from runs where link)""",
        "select piece, pos first_pos, pos + 1 second_pos from steps where n % 2 = 1",
    ),
)
def _(spark, d):
    from scorelake.operators.packing import consecutive_pairs

    n = t.notes(spark, d).withColumn("size", F.expr("qty % 4"))
    link = lambda nxt: (F.abs(F.col("size") - nxt["size"]) <= 1) & nxt["fret"].between(2, 18)
    return consecutive_pairs(n, ["piece"], "pos", ["size", "fret"], link)


@register(
    "jn18_tied_numbers",
    sql(
        "v_boxes",
        "nums as (select distinct frame, x0, x0 + 10 x1 from v_boxes)",
        "parens as (select distinct frame, x1 % 400 p, 3 w from v_boxes)",
        "arcs as (select distinct frame, x1 e from v_boxes)",
        """sides as (select n.frame, n.x0, n.x1, min(p) filter (n.x0 - (p + w) between -1 and 24) l,
            max(p) filter (p - n.x1 between -1 and 24) r from nums n join parens using (frame) group by all)""",
        """select frame, x0, l is not null and r is not null and exists (select 1 from arcs a
            where a.frame = s.frame and s.l - a.e between -1 and 40) tied from sides s""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    nums = b.select("frame", "x0").distinct()
    parens = b.select("frame", F.expr("x1 % 400").alias("p")).distinct()
    arcs = b.select("frame", F.col("x1").alias("e")).distinct()
    x0 = F.col("x0")
    left = iv.within(nums, parens, ["frame"], x0 - 27, x0 - 2, "p", 26).groupBy("frame", "x0").agg(F.min("p").alias("l"))
    right = iv.within(nums, parens, ["frame"], x0 + 9, x0 + 34, "p", 26).select("frame", "x0").distinct()
    closed = left.join(right, ["frame", "x0"])
    tied = iv.within(closed, arcs, ["frame"], F.col("l") - 40, F.col("l") + 1, "e", 42).select(
        "frame", "x0", F.lit(True).alias("t")
    ).distinct()
    return nums.join(tied, ["frame", "x0"], "left").select(
        "frame", "x0", F.coalesce("t", F.lit(False)).alias("tied")
    )


@register(
    "jn19_signature_mismatch",
    sql(
        "v_vec",
        "pairs as (select vid, vec_id, embedding e, lag(embedding) over (partition by vid order by vec_id) p from v_vec)",
        """cells as (select vid, vec_id, i // 8 r, i % 8 c, e[i + 1]::double > 0.15 a, p[i + 1]::double > 0.15 b
            from pairs, (select unnest(range(0, 64)) i) where p is not null)""",
        """lone as (select x.vid, x.vec_id, x.r, x.c, x.a, x.b,
            bool_or(y.a) filter (abs(x.r - y.r) <= 2 and abs(x.c - y.c) <= 2) na,
            bool_or(y.b) filter (abs(x.r - y.r) <= 2 and abs(x.c - y.c) <= 2) nb
            from cells x join cells y using (vec_id) group by all)""",
        """select vid, vec_id, case when count(*) filter (a) + count(*) filter (b) = 0 then 1.0::double else
            (count(*) filter (a and not nb) + count(*) filter (b and not na))::double
            / (count(*) filter (a) + count(*) filter (b)) end mismatch from lone group by vid, vec_id""",
    ),
)
def _(spark, d):
    v = t.vectors(spark, d).withColumn(
        "sig", bx.bitmap(F.expr("transform(embedding, e -> cast(e as double))"), 0.15)
    ).drop("embedding")
    pairs = scan(v, "vid", "vec_id", {"before": previous(F.col("sig"))}).where("before is not null")
    return pairs.select("vid", "vec_id", bx.mismatch(F.col("sig"), F.col("before")).alias("mismatch"))


@register(
    "jn20_boundary_labels",
    sql(
        "v_boxes",
        "bars as (select distinct frame, x0 bar from v_boxes)",
        "tok as (select frame, x1 % 400 x, min(supp % 12) lab, min(conf) conf from v_boxes group by all)",
        "near as (select frame, bar, x, x + 4 r, lab, conf from bars join tok using (frame) where x between bar - 30 and bar + 30)",
        """jumps as (select *, case when x - lag(r) over (partition by frame, bar order by x) <= 4 then 0 else 1 end j from near)""",
        "runs as (select *, sum(j) over (partition by frame, bar order by x) run from jumps)",
        """chains as (select frame, bar, min(x) a, max(r) z, bool_and(lab < 10) digits, min(conf) conf,
            string_agg(cast(lab as varchar), '' order by x) txt from runs group by frame, bar, run)""",
        """best as (select * from chains qualify row_number() over (partition by frame, bar order by
            case when a <= bar and bar <= z then 0 else least(abs(a - bar), abs(z - bar)) end, a) = 1)""",
        """select frame, bar, case when digits then cast(txt as bigint) end number,
            case when digits then conf else 0.0 end conf from best""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    bars = b.select("frame", F.col("x0").alias("bar")).distinct()
    tokens = b.groupBy("frame", F.expr("x1 % 400").alias("x")).agg(
        F.expr("min(supp % 12)").alias("lab"), F.min("conf").alias("conf")
    )
    bar = F.col("bar")
    near = iv.within(bars, tokens, ["frame"], bar - 30, bar + 30, "x", 61)
    w = Window.partitionBy("frame", "bar").orderBy("x")  # 61 pixels at most
    jump = F.when(F.col("x") - F.lag(F.col("x") + 4).over(w) <= 4, 0).otherwise(1)
    chains = near.withColumn("j", jump).withColumn("run", F.sum("j").over(w)).groupBy("frame", "bar", "run").agg(
        F.min("x").alias("a"),
        (F.max("x") + 4).alias("z"),
        F.bool_and(F.col("lab") < 10).alias("digits"),
        F.min("conf").alias("conf"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "lab"))), lambda g: g["lab"].cast("string")), "").alias("txt"),
    )
    far = F.when((F.col("a") <= bar) & (bar <= F.col("z")), 0).otherwise(
        F.least(F.abs(F.col("a") - bar), F.abs(F.col("z") - bar))
    )
    best = chains.groupBy("frame", "bar").agg(
        F.min_by(F.struct("digits", "txt", "conf"), F.struct(far, "a")).alias("c")
    )
    return best.select(
        "frame", "bar", F.when(F.col("c.digits"), F.col("c.txt").cast("long")).alias("number"),
        F.when(F.col("c.digits"), F.col("c.conf")).otherwise(0.0).alias("conf"),
    )


@register(
    "jn21_dots_to_beats",
    sql(
        "v_boxes",
        "dots as (select distinct frame, x1 % 400 x from v_boxes)",
        "words as (select distinct frame, x0 cx, x1 - x0 w from v_boxes where item % 4 = 0)",
        "beats as (select distinct frame, x0 bx from v_boxes where item % 4 <> 0)",
        """free as (select * from dots d where not exists (select 1 from words o where o.frame = d.frame
            and abs(cx - x) <= 9 + w // 2))""",
        """select frame, x, min_by(bx, abs(bx - x) * 1000 + bx) beat_x from free join beats using (frame)
           where abs(bx - x) <= 20 group by frame, x""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    at, cx, w = F.expr("x1 % 400"), F.col("x0"), F.col("x1") - F.col("x0")
    word = F.when(F.col("frame").isNotNull() & F.expr("item % 4 = 0"), F.struct(cx.alias("cx"), w.alias("w")))
    # a frame holds one image width of dots and of words a width; spreading words over pixels would be broadcast
    frames = b.groupBy("frame").agg(F.collect_set(at).alias("dots"), F.collect_set(word).alias("words"))
    taken = lambda x: F.exists("words", lambda o: F.abs(o["cx"] - x) <= 9 + F.floor(o["w"] / 2))
    free = frames.select("frame", F.explode(F.filter("dots", lambda x: ~F.coalesce(taken(x), F.lit(False)))).alias("x"))
    beats = b.where("item % 4 <> 0").select("frame", F.col("x0").alias("bx")).distinct()
    near = iv.within(free, beats, ["frame"], F.col("x") - 20, F.col("x") + 20, "bx", 41)
    return near.groupBy("frame", "x").agg(
        F.min_by("bx", F.struct(F.abs(F.col("bx") - F.col("x")), "bx")).alias("beat_x")
    )


@register(
    "jn22_kept_rests",
    sql(
        "v_boxes",
        "rests as (select distinct frame, x1 % 400 x, x1 % 400 + 8 r, supp % 60 y, supp % 60 + 12 b from v_boxes)",
        "nums as (select distinct frame, x0 l, x0 + 10 e from v_boxes)",
        """select frame, x, y, exists (select 1 from nums n where n.frame = r.frame and l <= x and e >= x + 4) circled
           from rests r where not (y <= 5 or b >= 65) and not exists (select 1 from nums n where n.frame = r.frame
             and greatest(r.x - e, l - r.r) < 3)""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    rest = F.struct(F.expr("x1 % 400").alias("x"), F.expr("supp % 60").alias("y"))
    # a frame holds one image width of numbers and of rests a height, so both meet in one row of it: nothing is spread
    # over pixels and joined, which Spark would take for a small table and broadcast
    frames = b.groupBy("frame").agg(
        F.collect_set(F.when(F.expr("not (supp % 60 <= 5 or supp % 60 + 12 >= 65)"), rest)).alias("rests"),
        F.collect_set(F.when(F.col("frame").isNotNull(), F.col("x0"))).alias("taken"),
    )
    meets = lambda cond: F.coalesce(F.exists("taken", cond), F.lit(False))
    kept = F.filter("rests", lambda r: ~meets(lambda l: F.greatest(r["x"] - (l + 10), l - (r["x"] + 8)) < 3))
    circled = lambda r: meets(lambda l: (l <= r["x"]) & (l + 10 >= r["x"] + 4)).alias("circled")
    return frames.select("frame", F.inline(F.transform(kept, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), circled(r)))))


@register(
    "jn23_marks_to_heads",
    sql(
        "v_boxes",
        "heads as (select distinct frame, x0 x, supp % 40 y from v_boxes)",
        "marks as (select distinct frame, x1 % 400 m, item % 40 my, item % 4 kind from v_boxes)",
        "stems as (select distinct frame, x from heads)",
        """owner as (select frame, m, min_by(x, abs(x - m) * 1000 + x) x from (select distinct frame, m from marks where kind = 1)
            join stems using (frame) group by all)""",
        "accented as (select frame, x from owner where abs(x - m) < 12)",
        """select frame, x, y,
            exists (select 1 from marks k where k.frame = h.frame and kind = 0 and abs(m - x) < 13 and abs(my - y) < 9) ghost,
            exists (select 1 from accented a where a.frame = h.frame and a.x = h.x) accent,
            exists (select 1 from marks k where k.frame = h.frame and kind = 2 and abs(m - x) < 8 and my < y) open_,
            exists (select 1 from marks k where k.frame = h.frame and kind = 3 and m - x between 1 and 12 and abs(my - y) < 7) dot
           from heads h""",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d)
    heads = b.select("frame", F.col("x0").alias("x"), F.expr("supp % 40").alias("y")).distinct()
    marks = b.select(
        "frame", F.expr("x1 % 400").alias("m"), F.expr("item % 40").alias("my"), F.expr("item % 4").alias("kind")
    ).distinct()
    x = F.col("x")
    near = iv.within(heads, marks, ["frame"], x - 12, x + 12, "m", 25)
    gap, rise = F.abs(F.col("m") - x), F.abs(F.col("my") - F.col("y"))
    flags = near.groupBy("frame", "x", "y").agg(
        F.bool_or((F.col("kind") == 0) & (rise < 9)).alias("ghost"),
        F.bool_or((F.col("kind") == 2) & (gap < 8) & (F.col("my") < F.col("y"))).alias("open_"),
        F.bool_or((F.col("kind") == 3) & (F.col("m") > x) & (rise < 7)).alias("dot"),
    )
    zero = F.lit(0).cast("long")
    accents = marks.where("kind = 1").select("frame", F.col("m").alias("x")).distinct().withColumn("tie", zero)
    stems = heads.select("frame", "x").distinct().withColumn("tie", zero)
    owner = sampling.nearest(accents, stems, ["frame"], "x", "tie", [])
    accented = owner.where(F.abs(F.col("found.x") - x) < 12).select(
        "frame", F.col("found.x").alias("x"), F.lit(True).alias("accent")
    ).distinct()
    out = heads.join(flags, ["frame", "x", "y"], "left").join(accented, ["frame", "x"], "left")
    return out.select(
        "frame", "x", "y", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("ghost", "accent", "open_", "dot")]
    )


@register(
    "seq23_screen_measures",
    sql(
        "v_notes",
        *PERIODS_SQL,
        "bars as (select distinct piece, fret * 4 x from v_notes)",
        """snapped as (select p.piece, period, coalesce(max(x) filter (x between x0 - 10 and x0 + 6), x0) a,
            coalesce(min(x) filter (x between x1 - 6 and x1 + 10 and x > x0 + 20), x1) b
            from periods p join bars using (piece) group by p.piece, period, x0, x1)""",
        "lit as (select piece, a, b from snapped where b - a >= 20)",
        "edges as (select piece, x a, lead(x) over (partition by piece order by x) b from bars)",
        """plain as (select piece, a, b from edges where b - a >= 20 union all
            select piece, 0, min(x) from bars group by piece)""",
        """select distinct piece, a, b, true highlighted from lit union all
           select piece, a, b, false from plain where piece not in (select piece from periods)""",
    ),
)
def _(spark, d):
    n = t.notes(spark, d)
    checkpoint_folder(spark)  # both are read several times, also by jobs that look for cut marks
    bars = n.select("piece", F.expr("fret * 4").alias("x")).distinct().checkpoint()
    periods = segments.highlight_periods(highlight_spans(spark, d), ["piece"], "pos", "pos", "a", "b")
    kinds = periods.select("piece", "x0", "x1").distinct().checkpoint()
    lit = iv.snap(kinds, bars, ["piece"], 10).where("right_x - left_x >= 20").select(
        "piece", F.col("left_x").alias("a"), F.col("right_x").alias("b"), F.lit(True).alias("highlighted")
    ).distinct()
    w = Window.partitionBy("piece").orderBy("x")
    inner = bars.select("piece", F.col("x").alias("a"), F.lead("x").over(w).alias("b")).where("b - a >= 20")
    head = bars.groupBy("piece").agg(F.min("x").alias("b")).select("piece", F.lit(0).cast("long").alias("a"), "b")
    plain = inner.unionByName(head).join(kinds.select("piece").distinct(), "piece", "left_anti")
    return lit.unionByName(plain.withColumn("highlighted", F.lit(False)))
