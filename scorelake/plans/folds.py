"""Sequential rules: clusters, packing, suppression, repair, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import clusters, ordered
from scorelake.operators.fold import fold
from scorelake.operators.packing import packed_lines, packed_pages, suppressed
from scorelake.operators.repair import repaired_numbers
from scorelake.plans.registry import register, sql
from scorelake.sources import tables as t

c = F.col


def walk(name: str, source: str, keys: str, init: str, step: str) -> str:
    """A recursive walk over the rows ``i`` = 1, 2, ... of ``source`` per key."""
    return f"""{name} as (with recursive w as ({init} union all {step}) select * from w)"""


@register(
    "seq16_anchored_columns",
    sql(
        "v_boxes",
        "pl as (select frame, x0 x, row_number() over (partition by frame order by x0) i from (select distinct frame, x0 from v_boxes))",
        walk("cols", "pl", "frame", "select frame, i, x, x start from pl where i = 1",
             "select p.frame, p.i, p.x, case when p.x - w.start > 40 then p.x else w.start end from w join pl p on p.frame = w.frame and p.i = w.i + 1"),
        "select frame, x, start from cols",
    ),
)
def _(spark, d):
    places = t.boxes(spark, d).select("frame", c("x0").alias("x")).distinct()
    return fold(places, ["frame"], ["x"], ["x"], clusters.Columns, "x bigint, start bigint")


BEATS = [
    "pl as (select *, row_number() over (partition by frame order by x) i from (select frame, x0 x, count(*) n from v_boxes where supp % 5 > 0 group by all))",
    walk("ws", "pl", "frame", "select frame, i, x, n, x start, list_transform(range(n), lambda k: x) cur from pl where i = 1",
         """select p.frame, p.i, p.x, p.n, case when abs(p.x - list_median(w.cur)) <= 12 then w.start else p.x end,
            case when abs(p.x - list_median(w.cur)) <= 12 then list_concat(w.cur, list_transform(range(p.n), lambda k: p.x)) else list_transform(range(p.n), lambda k: p.x) end
            from w join pl p on p.frame = w.frame and p.i = w.i + 1"""),
]


@register("seq17_median_beats", sql("v_boxes", *[b.replace(" where supp % 5 > 0", "") for b in BEATS], "select frame, x, n, start beat_x from ws"))
def _(spark, d):
    beats = clusters.beat_places(t.boxes(spark, d), ["frame"], "x0", 12)
    return beats.select("frame", F.get("places", F.lit(0))["x"].alias("beat_x"), F.inline("places"))


@register(
    "seq17_beats_with_rests",
    sql("v_boxes", *BEATS, """select frame, median(x) x, count(*) notes, false rest from (select frame, start, unnest(list_transform(range(n), lambda k: x)) x from ws) group by frame, start
        union all select frame, x0, 0, true from v_boxes where supp % 5 = 0"""),
)
def _(spark, d):
    b = t.boxes(spark, d)
    return clusters.placed_beats(b.where("supp % 5 > 0"), b.where("supp % 5 = 0"), ["frame"], "x0", 12)


def blobs(spark, d):
    rows = t.boxes(spark, d).select(
        "frame", c("x0").alias("x"), F.expr("4 + supp % 9").alias("w"), F.expr("line_ * 6").alias("y"), F.expr("8 + supp % 5").alias("h")
    )
    return rows.groupBy("frame", "x", "y").agg(F.max("w").alias("w"), F.max("h").alias("h"))


RUN_FIT = """list_position(list_transform(w.runs, lambda r: p.x - r.a <= 7 and least(r.b, p.y + p.h) - greatest(r.t, p.y) >= 0.3 * least(p.h, r.b - r.t)), true)"""


@register(
    "seq18_text_runs",
    sql(
        "v_boxes",
        "bl as (select frame, x0 x, line_ * 6 y, max(4 + supp % 9) w, max(8 + supp % 5) h from v_boxes group by all)",
        "pl as (select *, row_number() over (partition by frame order by x, y) i from bl)",
        walk("ws", "pl", "frame", "select frame, i, x, y, x rx, y ry, [{'x': x, 'y': y, 'a': x + w, 't': y, 'b': y + h}] runs from pl where i = 1",
             f"""select frame, i, x, y, case when k > 0 then runs[k].x else x end, case when k > 0 then runs[k].y else y end,
                case when k > 0 then list_transform(runs, lambda r, j: case when j = k then {{'x': r.x, 'y': r.y, 'a': greatest(r.a, x + wd), 't': least(r.t, y), 'b': greatest(r.b, y + h)}} else r end)
                else list_append(runs, {{'x': x, 'y': y, 'a': x + wd, 't': y, 'b': y + h}}) end
                from (select p.frame, p.i, p.x, p.y, p.w wd, p.h, w.runs, coalesce({RUN_FIT}, 0) k from w join pl p on p.frame = w.frame and p.i = w.i + 1)"""),
        "select frame, x, y, rx run_x, ry run_y from ws",
    ),
)
def _(spark, d):
    return clusters.text_runs(blobs(spark, d), ["frame"], 7, 0.3)


@register(
    "seq19_even_gap_groups",
    sql(
        "v_boxes",
        "ln as (select distinct frame // 4 vid, x0 // 4 * 4 y from v_boxes)",
        "pl as (select *, row_number() over (partition by vid order by y) i, count(*) over (partition by vid) total from ln)",
        walk("ws", "pl", "vid", "select vid, i, total, y a, y z, 0::bigint g, 1::bigint n, null::bigint oa, null::bigint oz, null::bigint o from pl where i = 1",
             """select vid, i, total, case when f then a when n < 4 and d >= 4 then z else y end, y, d, case when f then n + 1 when n < 4 and d >= 4 then 2 else 1 end,
                case when not f and n >= 4 then a end, case when not f and n >= 4 then z end, case when not f and n >= 4 then n end
                from (select p.vid, p.i, p.total, p.y, w.a, w.z, w.n, p.y - w.z d, case when w.n = 1 then p.y - w.z >= 4 else abs(p.y - w.z - w.g) <= 0.2 * w.g + 1 end f
                    from w join pl p on p.vid = w.vid and p.i = w.i + 1)"""),
        "select vid, oa first_y, oz last_y, o lines from ws where o is not null union all select vid, a, z, n from ws where i = total and n >= 4",
    ),
)
def _(spark, d):
    lines = t.boxes(spark, d).select(F.expr("frame div 4").alias("vid"), F.expr("x0 div 4 * 4").alias("y"))
    found = clusters.even_groups(lines, ["vid"], "y", 4, 0.2)
    return found.select("vid", c("first").alias("first_y"), c("last").alias("last_y"), "lines")


@register("seq9_merge_adjacent_similar")
def _(spark, d):
    pages = t.vectors(spark, d).withColumns({"start": c("vec_id"), "end": F.expr("vec_id + 1 + label % 3")})
    return fold(
        pages, ["vid"], ["vec_id"], ["vec_id", "start", "end", "embedding"], clusters.MergeAdjacent,
        "kept bigint, start bigint, end_ bigint",
    )


@register(
    "win16_suppression",
    sql(
        "v_boxes",
        "cd as (select frame, supp % 3 string_, x0 x, max(conf) conf from v_boxes group by all)",
        "rk as (select *, row_number() over (partition by frame, string_ order by conf desc, x) i from cd)",
        walk("ws", "rk", "frame, string_", "select frame, string_, i, x, conf, [x] kept, true keep from rk where i = 1",
             """select r.frame, r.string_, r.i, r.x, r.conf, case when len(list_filter(w.kept, lambda k: abs(k - r.x) < 30)) = 0 then list_append(w.kept, r.x) else w.kept end,
                len(list_filter(w.kept, lambda k: abs(k - r.x) < 30)) = 0 from w join rk r on r.frame = w.frame and r.string_ = w.string_ and r.i = w.i + 1"""),
        "select frame, string_, x, conf from ws where keep",
    ),
)
def _(spark, d):
    b = t.boxes(spark, d).select("frame", F.expr("supp % 3").alias("string_"), c("x0").alias("x"), "conf")
    return suppressed(b, ["frame", "string_"], 30)


@register(
    "udf3_line_packing",
    sql(
        "v_boxes",
        "ct as (select distinct frame, unnest([0, 500, x0]) x from v_boxes)",
        "rk as (select frame, x, row_number() over (partition by frame order by x) i, count(*) over (partition by frame) n from ct)",
        walk("ws", "rk", "frame", "select frame, i, n, x a, x b, null::bigint la, null::bigint lb from rk where i = 1",
             """select r.frame, r.i, r.n, case when r.x - w.a > 150 and w.b > w.a then w.b else w.a end, r.x,
                case when r.x - w.a > 150 and w.b > w.a then w.a end, case when r.x - w.a > 150 and w.b > w.a then w.b end
                from w join rk r on r.frame = w.frame and r.i = w.i + 1"""),
        "select frame, la a, lb b from ws where la is not null union all select frame, a, b from ws where i = n",
    ),
)
def _(spark, d):
    cuts = t.boxes(spark, d).groupBy("frame").agg(F.collect_set("x0").alias("x"))  # pixels
    ends = F.array(F.lit(0).cast("long"), F.lit(500).cast("long"))
    return packed_lines(cuts.select("frame", F.array_sort(F.array_union("x", ends)).alias("cuts")), ["frame"], "cuts", 150)


@register(
    "udf3_page_packing",
    sql(
        "v_notes",
        "it as (select piece, pos, 20 + qty * 3 size from v_notes)",
        walk("ws", "it", "piece", "select piece, pos, 0::bigint page, 0::bigint at_, size used from it where pos = 1",
             """select r.piece, r.pos, case when w.used + 10 + r.size > 300 then w.page + 1 else w.page end, case when w.used + 10 + r.size > 300 then 0 else w.used + 10 end,
                case when w.used + 10 + r.size > 300 then r.size else w.used + 10 + r.size end from w join it r on r.piece = w.piece and r.pos = w.pos + 1"""),
        "select piece, pos, page, at_ from ws",
    ),
)
def _(spark, d):
    items = t.notes(spark, d).withColumn("size", c("qty") * 3 + 20)
    return packed_pages(items, ["piece"], "pos", "size", 300, 10).withColumnRenamed("at", "at_")


def sightings(spark, d):
    notes = t.notes(spark, d)
    n = notes.select(
        *ordered.relabelled(notes, "piece", "pos"), "piece", "pos", F.expr("pos div 3").alias("screen"), F.expr("string_ * 60").alias("x0"),
        F.expr("string_ * 60 + 20 + fret * 2").alias("x1"), (c("pos") * 2.0).alias("start"),
        F.expr("cast(pos * 2 + 0.5 + qty / 20.0 as double)").alias("end"), F.expr("partkey % 3 <> 0").alias("complete"),
        F.expr("qty % 3 > 0").alias("lit"), F.expr("shiftleft(255L, cast(partkey % 3 * 8 as int)) | shiftleft(1L, cast(suppkey % 60 as int))").alias("sig"),
    )
    spans = n.select(F.expr("piece div 50").alias("job"), (c("end") - c("start")).alias("len"))
    typical = ordered.median(spans, ["job"], "len", "typical").checkpoint()
    return n.withColumn("job", F.expr("piece div 50")).join(typical, "job")


SIGHTING = ["screen", "x0", "x1", "start", "end", "complete", "typical"]
SCREENS = "screen bigint, x0 bigint, x1 bigint, start double, end_ double, complete boolean"


def grown_sql(m: str) -> str:
    """An 8 by 8 bitmap with its ink grown by two cells, in whole numbers of 128 bits."""
    def mask(keep):
        return sum(1 << (8 * r + k) for r in range(8) for k in range(8) if keep(k))

    w = f"({m} | (({m} & {mask(lambda k: k < 7)}) << 1) | (({m} & {mask(lambda k: k < 6)}) << 2) | (({m} & {mask(lambda k: k > 0)}) >> 1) | (({m} & {mask(lambda k: k > 1)}) >> 2))"
    return f"(({w} | ({w} << 8) | ({w} << 16) | ({w} >> 8) | ({w} >> 16)) & {2**64 - 1}::hugeint)"


def screens_sql(lit: str) -> str:
    alike = "coalesce((bit_count(k.sig & ~p.gr) + bit_count(p.sig & ~k.gr))::double / nullif(bit_count(k.sig) + bit_count(p.sig), 0), 1.0) < 0.35"
    timed = "p.typical > 0 and p.start - k.z <= 1.0 and p.end_ - k.a <= 1.4 * p.typical"
    return sql(
        "v_notes",
        f"""n as (select piece, pos i, pos // 3 screen, string_ * 60 x0, string_ * 60 + 20 + fret * 2 x1, (pos * 2.0)::double start, (pos * 2 + 0.5 + qty / 20.0)::double end_, partkey % 3 <> 0 complete,
            {lit} lit, ((255::hugeint << (partkey % 3 * 8)::int) | (1::hugeint << (suppkey % 60)::int)) sig from v_notes)""",
        f"""pl as (select *, {grown_sql('sig')} gr, median(end_ - start) over (partition by piece // 50) typical, count(*) over (partition by piece) total from n)""",
        walk("ws", "pl", "piece", "select piece, i, total, screen, x0, x1, start a, end_ z, complete, lit, sig, gr, null::bigint os, null::bigint o0, null::bigint o1, null::double oa, null::double oz, null::boolean oc from pl where i = 1",
             f"""select piece, i, total, case when b then ps else screen end, case when b then p0 else x0 end, case when b then p1 else x1 end, case when same then a else start end, end_, case when b then pc else complete end,
                case when b then pl_ else lit end, case when b then psig else sig end, case when b then pgr else gr end, case when not same then screen end, case when not same then x0 end, case when not same then x1 end,
                case when not same then a end, case when not same then z end, case when not same then complete end
                from (select p.piece, p.i, p.total, p.screen ps, p.x0 p0, p.x1 p1, p.start, p.end_, p.complete pc, p.lit pl_, p.sig psig, p.gr pgr, k.screen, k.x0, k.x1, k.a, k.z, k.complete, k.lit, k.sig, k.gr,
                    k.screen <> p.screen and case when k.lit and p.lit then {timed} else {alike} end same,
                    not (k.screen <> p.screen and case when k.lit and p.lit then {timed} else {alike} end) or (p.complete and not k.complete) or (p.complete = k.complete and p.x1 - p.x0 > k.x1 - k.x0) b
                    from w k join pl p on p.piece = k.piece and p.i = k.i + 1)"""),
        "select piece, os screen, o0 x0, o1 x1, oa start, oz end_, oc complete from ws where os is not null union all select piece, screen, x0, x1, a, z, complete from ws where i = total",
    )


@register("str7_screens_merged", screens_sql("true"))
def _(spark, d):
    return fold(sightings(spark, d), ["piece"], ["pos"], SIGHTING, clusters.Screens, SCREENS)


@register("str7_screens_lit_or_alike", screens_sql("qty % 3 > 0"))
def _(spark, d):
    return fold(sightings(spark, d), ["piece"], ["pos"], [*SIGHTING, "lit", "sig"], clusters.Screens, SCREENS)


@register(
    "udf1_repaired_numbers",
    sql(
        "v_notes",
        """n as (select piece, pos - 1 i, case when conf * 10 >= 0.5 and partkey % 4 <> 0 then pos + 10 + case when suppkey % 7 = 0 then suppkey % 5 else 0 end end vote,
            cast(round_even(cast(conf * 10 as double) * 1000, 0) as bigint) w from v_notes)""",
        "o as (select distinct piece, vote - i o from n where vote is not null union select piece, 1 from n group by piece having count(vote) = 0)",
        "g as (select piece, i, o, case when vote is null then 0 when vote - i = o then 2 * w else -w end gain from n join o using (piece))",
        """f as (select piece, i, o, gain score, o way from g where i = 0
            union all select x.piece, g.i, x.o, greatest(x.score, x.top - 5000) + g.gain, case when x.score >= x.top - 5000 then x.o else x.topo end
            from (select *, max(score) over (partition by piece) top, first_value(o) over (partition by piece order by score desc, o) topo from f) x
            join g on g.piece = x.piece and g.o = x.o and g.i = x.i + 1)""",
        """b as (select piece, i, o from (select *, row_number() over (partition by piece order by i desc, score desc, o) r from f) where r = 1
            union all select b.piece, b.i - 1, f.way from b join f on f.piece = b.piece and f.i = b.i and f.o = b.o where b.i > 0)""",
        "select piece, i place, i + o number from b",
    ).replace("with ", "with recursive ", 1),
)
def _(spark, d):
    notes = t.notes(spark, d)
    n = notes.select(
        *ordered.relabelled(notes, "piece", "place"), "piece", (c("pos") - 1).alias("place"),
        F.expr("case when partkey % 4 <> 0 then pos + 10 + case when suppkey % 7 = 0 then suppkey % 5 else 0 end end").alias("number"),
        (c("conf") * 10).alias("conf"),
    )
    return repaired_numbers(n, ["piece"], "place", "number", "conf")
