"""Small literal cases per operator."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import boxes, music, ticks
from scorelake.operators import clusters, edits, mapping, notation, packing, reports, sampling, segments, timing, voices
from scorelake.sources import documents

T = ticks.TICKS


def one(df):
    return df.first()


def test_first_row_of_each_cell(spark):
    rows = [("a", i, t) for i, t in enumerate([0, 150_000, 200_000, 390_000, 400_000, 1_000_000])]
    df = spark.createDataFrame(rows, "vid string, id long, t long")
    out = sampling.first_per_cell(df, ["vid"], "t", 200_000, "id").orderBy("t")
    assert [r.id for r in out.collect()] == [0, 2, 4, 5]


def test_segments_split_on_changes_and_drop_short_runs(spark):
    values = [1.0] * 5 + [200.0] + [90.0] * 5
    df = spark.createDataFrame([("v", i, i * 200_000, v) for i, v in enumerate(values)], "vid string, id long, t long, value double")
    out = segments.stable_segments(df, ["vid"], "t", "id", "value", 40, 200_000, 800_000).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us, r.n) for r in out] == [(0, 1_000_000, 5), (1_200_000, 2_200_000, 5)]


def test_column_change(spark):
    a = [0.0] * 16
    b = [float(v) for v in (9, 0, 0, 0, 9, 9, 0, 0, 0, 9, 0, 0, 0, 0, 0, 9)]  # columns 0 and 1 change twice
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert one(df.select(segments.column_change(F.col("a"), F.col("b"), 4, 4, 5).alias("s"))).s == 0.5


def test_median_composite(spark):
    df = spark.createDataFrame(
        [(3, [(0, [1, 9]), (1, [2, 8]), (2, [30, 1])]), (2, [(0, [0, 0]), (1, [4, 1])])],
        "n int, m array<struct<idx:long,vec:array<long>>>",
    )
    got = {r.n: list(r.v) for r in df.select("n", segments.median_composite(F.col("m"), 2).alias("v")).collect()}
    assert got == {3: [2, 8], 2: [0, 0]}  # the first of two equally near members


def test_box_overlap_and_clamp(spark):
    df = spark.range(1).select(
        boxes.iou(
            F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (0, 0, 10, 10))]),
            F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (5, 0, 10, 10))]),
        ).alias("i"),
        boxes.clamp(F.lit(-5), F.lit(90), F.lit(500), F.lit(20), 100, 80).alias("c"),
    )
    r = one(df)
    assert r.i == pytest.approx(1 / 3) and tuple(r.c) == (0, 79, 100, 1)


def _stem(beams=0, dot=False, short=False):
    return dict(stem=True, beams=beams, beam_conf=1.0, dot=dot, tuplet=None, circled=False, rest_kind=None, short_stem=short, guess=None)


SOLVES = {
    "plain": ([_stem(1)] * 8, [(8, 0, None)] * 8),
    "misread beam": ([_stem(1)] * 7 + [_stem(2)], [(8, 0, None)] * 8),
    "dotted half": ([_stem(0, True, True), _stem(1), _stem(1)], [(2, 1, None), (8, 0, None), (8, 0, None)]),
    "triplet": ([_stem(0, short=True)] + [_stem(0)] * 3, [(2, 0, None)] + [(4, 0, 3)] * 3),
}


def test_exact_sum_solver(spark):
    rows = [(m, i, *e.values(), T) for m, (ev, _) in SOLVES.items() for i, e in enumerate(ev)]
    df = spark.createDataFrame(rows, "m string, pos long, stem boolean, beams long, beam_conf double, dot boolean, tuplet long, circled boolean, rest_kind string, short_stem boolean, guess long, room long")
    read = timing.with_readings(df, "options", spacing_guess="guess", **{x: x for x in ("stem", "beams", "beam_conf", "dot", "tuplet", "circled", "rest_kind", "short_stem")})
    out = timing.solve_measures(read, ["m"], "pos", "options", "room").collect()
    for m, (_, want) in SOLVES.items():
        got = sorted((r for r in out if r.m == m), key=lambda r: r.pos)
        assert all(r.ok for r in got)
        assert [(r.duration, r.dots, r.tuplet) for r in got] == want, m


def test_overlong_beats_are_made_writable(spark):
    beats = [(0, 0, 2), (1, T // 4, 4), (2, T // 4, 8), (3, T * 15 // 16, 4), (4, T, 4)]
    df = spark.createDataFrame([(1, p, o, d, 0, None, False, T) for p, o, d in beats], "m long, pos long, onset long, duration long, dots long, tuplet long, rest boolean, cap long")
    out = timing.placed_voices(df, ["m"], "cap").orderBy("pos").collect()
    assert [r.start for r in out] == [0, T // 4, T // 2, T * 15 // 16]
    assert out[0].duration == 4 and out[3].start + out[3].length <= T


def test_spelling(spark):
    df = spark.createDataFrame([(T // 2,), (T * 3 // 8,), (T * 7 // 16,), (T // 5,), (100,)], "n long")
    got = df.select("n", ticks.spell(F.col("n")).alias("s"), ticks.largest_fitting(F.col("n")).alias("f")).collect()
    assert [tuple(r.s) for r in got] == [(2, 0), (4, 1), (4, 2), (None, None), (None, None)]
    assert [tuple(r.f)[:2] for r in got] == [(2, 0), (4, 1), (4, 1), (8, 1), (64, 0)]


DRUMS = [
    ("A", 5, "x", False, 49), ("G", 5, "x", False, 42), ("G", 5, "x", True, 46), ("F", 5, "x", False, 51), ("E", 5, "normal", False, 50),
    ("D", 5, "normal", False, 47), ("C", 5, "normal", False, 38), ("C", 5, "hollow", False, 38), ("A", 4, "normal", False, 43),
    ("F", 4, "normal", False, 36), ("D", 4, "x", False, 44), ("G", 5, "circle-x", False, 46), ("B", 3, "normal", False, 35),
    ("E", 5, "x", False, 51),
]


def test_drum_lookup(spark):
    df = spark.createDataFrame(DRUMS, "step string, octave long, notehead string, open_ boolean, want long")
    assert mapping.resolve(df, mapping.preset(spark, "default")).where("gm <> want or gm is null").count() == 0
    own = spark.createDataFrame([("C5:normal", 40), ("G5:x", 46)], "key string, gm long")
    table = mapping.with_overrides(mapping.preset(spark, "default"), own)
    got = {(r.step, r.notehead): r.gm for r in mapping.resolve(df.where("octave = 5 and not open_"), table).collect()}
    assert got["C", "normal"] == 40 and got["G", "x"] == 46 and got["E", "normal"] == 50


@pytest.mark.parametrize(
    ("numbers", "want"),
    [
        ([3, 4], [(1, 1.0, True), (2, 1.0, True), (3, 1.0, False), (4, 1.0, False)]),
        ([1, 2, 5], [(1, 1.0, False), (2, 1.0, False), (3, 0.0, True), (4, 0.0, True), (5, 1.0, False)]),
        ([5, 4], [(4, 1.0, False), (5, 1.0, False)]),
        ([0, 1], [(0, 1.0, False), (1, 1.0, False)]),
        ([2, None, 4], [(None, 1.0, False), (2, 1.0, False), (4, 1.0, False)]),
    ],
)
def test_gap_filling(spark, numbers, want):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(numbers)], "piece string, pos long, number long")
    out = reports.filled_numbers(df, "piece", "number").orderBy("number").collect()
    assert [(r.number, r.confidence, r.rest) for r in out] == want


URLS = {
    "BV1xx411c7mD": "https://www.bilibili.com/video/BV1xx411c7mD",
    "  https://m.youtube.com/watch?v=dQw4w9WgXcQ ": "https://m.youtube.com/watch?v=dQw4w9WgXcQ",
    "youtu.be/abc": "https://youtu.be/abc",
    "https://example.com/v": None, "https://notyoutube.com/x": None, "hello": None,
    "https://evil.example#.youtube.com/x": None, "https://evil.example?.youtube.com": None,
}


def test_links(spark):
    df = spark.createDataFrame(list(URLS.items()), "text string, want string")
    assert df.where(~documents.normal_url(F.col("text")).eqNullSafe(F.col("want"))).count() == 0


def test_tunings(spark):
    df = spark.createDataFrame([("E4 B3 G3 D3 A2 E2", 6), ("E4, B3", 3), ("H4 E2", 2), ("Bb1 a0", 2)], "t string, n int")
    got = [r.p for r in df.select(music.parse_tuning(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == [[40, 45, 50, 55, 59, 64], None, None, [21, 34]]
    assert one(spark.range(1).select(music.default_tuning(F.lit(8)).alias("t"))).t == [30, 35, 40, 45, 50, 55, 59, 64]


def _accidentals(spark, rows, fifths=0):
    df = spark.createDataFrame(
        [(m, s, i, st, o, a, tied, mark, fifths) for i, (m, s, st, o, a, tied, mark) in enumerate(rows)],
        "measure int, staff int, pos int, step string, octave int, alter_ int, tied boolean, has_mark boolean, key_ int",
    )
    return [r.mark for r in notation.accidentals(df, ["measure", "staff"], "pos").orderBy("pos").collect()]


def test_accidentals(spark):
    n = lambda m, st, o, a=0, staff=1, tied=False, mark=False: (m, staff, st, o, a, tied, mark)
    assert _accidentals(spark, [n(1, "E", 5), n(1, "D", 5, 1), n(1, "D", 5, 1), n(2, "D", 5, 1)]) == [None, "sharp", None, "sharp"]
    assert _accidentals(spark, [n(1, "D", 5, 1), n(1, "D", 5)]) == ["sharp", "natural"]
    assert _accidentals(spark, [n(1, "F", 4, 1), n(1, "F", 4), n(1, "C", 4, -1)], 1) == [None, "natural", "flat"]
    assert _accidentals(spark, [n(1, "D", 5, 1), n(1, "D", 4, 1), n(1, "D", 5, 1, staff=2)]) == ["sharp"] * 3
    assert _accidentals(spark, [n(1, "G", 4, 1), n(1, "G", 4, 1, tied=True)]) == ["sharp", None]


def test_older_onsets(spark):
    df = spark.createDataFrame([("1/4", T // 4), ("3/16", T * 3 // 16), ("1.5", T * 3 // 8), ("0.3333", T // 12), ("1/11", None)], "t string, want long")
    assert df.where(~documents.onset_ticks(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_last_edit_counts_and_dead_notes_are_not_tied(spark):
    notes = spark.createDataFrame([(1, 0, 3, False, True, 0.5), (1, 1, 5, False, True, 0.5)], "b long, s long, fret long, dead boolean, tied boolean, conf double")
    log = spark.createDataFrame([(1, 0, 1, "set", 7), (1, 0, 2, "dead", None), (1, 1, 3, "set", 99), (1, 2, 4, "set", 2)], "b long, s long, seq long, op string, value long")
    out = {r.s: r for r in edits.set_frets(notes, log, ["b", "s"]).collect()}
    assert (out[0].fret, out[0].dead, out[0].tied, out[0].conf) == (0, True, False, 1.0)
    assert (out[1].fret, out[1].tied, out[1].conf) == (5, True, 0.5)  # fret 99 is no valid edit
    assert (out[2].fret, out[2].tied) == (2, False)


def test_pedal_voice_without_rests_follows_the_other_voice(spark):
    option = [(4, 0, None, 1.0)]
    hands, feet = [(i, 1, 100 * i) for i in range(4)], [(9, 2, 2), (10, 2, 203)]
    rows = [(1, *e, False, False, option, T) for e in hands + feet]
    schema = "m long, pos long, voice long, x long, rest boolean, dotted_rest boolean, options array<struct<duration:long,dots:long,tuplet:long,p:double>>, room long"
    out = voices.timed_voices(spark.createDataFrame(rows, schema), ["m"], "room", 400).collect()
    assert len(out) == 6 and all(r.ok for r in out)
    assert sorted((r.pos, r.onset) for r in out if r.voice == 2) == [(9, 0), (10, T // 2)]


def test_voices_that_only_add_up_together(spark):
    option = [(4, 0, None, 1.0)]
    rows = [(1, k, 1 + k % 2, 100 * k, False, False, option, T) for k in range(4)]
    schema = "m long, pos long, voice long, x long, rest boolean, dotted_rest boolean, options array<struct<duration:long,dots:long,tuplet:long,p:double>>, room long"
    out = voices.timed_voices(spark.createDataFrame(rows, schema), ["m"], "room", 400).collect()
    assert sorted((r.pos, r.onset, r.ok) for r in out) == [(k, k * T // 4, True) for k in range(4)]


def test_groups_keep_their_rules(spark):
    c = clusters.Columns()
    assert [c.row(x)[0][1] for x in (0, 30, 40, 50, 95)] == [0, 0, 0, 50, 95]
    lines = spark.createDataFrame([(1, y) for y in (0, 10, 20, 30, 80, 90, 100, 110, 120)] + [(2, 5)], "f long, y long")
    assert [tuple(r) for r in clusters.even_groups(lines, ["f"], "y", 4, 0.2).collect()] == [(1, 0, 30, 4), (1, 80, 120, 5)]
    items = spark.createDataFrame([(1, i, s) for i, s in enumerate((200, 90, 10, 400, 5))], "f long, i long, size long")
    pages = packing.packed_pages(items, ["f"], "i", "size", 300, 10).orderBy("i").collect()
    assert [(r.page, r["at"]) for r in pages] == [(0, 0), (0, 210), (1, 0), (2, 0), (3, 0)]


def test_beats_of_notes_and_rests(spark):
    notes = spark.createDataFrame([("f", x) for x in (10, 14, 14, 30, 100)], "frame string, x long")
    rests = spark.createDataFrame([("f", 12), ("g", 50)], "frame string, x long")
    got = clusters.placed_beats(notes, rests, ["frame"], "x", 12).collect()
    assert sorted(map(tuple, got)) == [("f", 12.0, 0, True), ("f", 14.0, 3, False), ("f", 30.0, 1, False), ("f", 100.0, 1, False), ("g", 50.0, 0, True)]


def test_sightings_of_two_screens():
    kept = {"screen": 0, "lit": False, "sig": 255, "start": 0.0, "end": 2.0}
    s = clusters.Screens()
    assert s.one_item(kept, kept | {"screen": 1}, 0.0) and not s.one_item(kept, kept, 0.0)
    assert not s.one_item(kept, kept | {"screen": 1, "sig": 255 << 40}, 0.0)
    lit = kept | {"lit": True}
    assert s.one_item(lit, lit | {"screen": 1, "start": 2.5, "end": 4.0}, 3.0) and not s.one_item(lit, lit | {"screen": 1, "start": 3.5, "end": 4.0}, 3.0)
    assert not s.one_item(lit, lit | {"screen": 1, "start": 2.5, "end": 4.0}, 0.0)


def test_an_unknown_track_is_an_error(spark):
    known = spark.createDataFrame([("Drums",), ("Bass",)], "name string")
    asked = spark.createDataFrame([("Bass",), ("Bass",)], "name string")
    assert documents.only_known(asked, known, "name").count() == 2
    with pytest.raises(ValueError, match="'Horn'"):
        documents.only_known(asked.union(spark.createDataFrame([("Horn",)], "name string")), known, "name")


def test_numbers_against_the_sequence(spark):
    rows = [("p", 5, 1, 5, 5), ("p", 6, 2, None, 6), ("p", 7, 3, 6, 6), ("p", 9, 4, 8, 9), ("q", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "piece string, measure long, place long, read long, final long")
    got = {r.piece: r for r in reports.numbering(df, ["piece"], "measure", "place", "read", "final").collect()}
    p, q = got["p"], got["q"]
    assert (p.measures, p.ocr_read, p.agrees, p.duplicates, p.in_sequence, p.read_in_sequence) == (4, 3, 2, 1, 2, 2)
    assert (q.measures, q.ocr_read, q.duplicates, q.in_sequence) == (1, 0, 0, 0)
