"""Literal cases of nested, linked and written documents, and of edits and comparisons."""

import json

import pytest
from pyspark.sql import functions as F

from scorelake.operators import edits, reports
from scorelake.sources import checks, documents, linked, sinks


def first_fault(spark, doc, rule=checks.SONG):
    text = doc if isinstance(doc, str) or doc is None else json.dumps(doc)
    r = checks.checked(spark.createDataFrame([(1, text)], "id long, doc string"), "doc", rule).first()
    return None if r.reason is None else (r.path, r.reason)


NOTES = [
    ({"bend": "full"}, "bend"), ({"bend_release": 1}, "bend_release"), ({"slide": "sideways"}, "slide"), ({"slide_in": 3}, "slide_in"), ({"hopo": "yes"}, "hopo"),
    ({"harmonic": "loud"}, "harmonic"), ({"harmonic_fret": "12"}, "harmonic_fret"), ({"vibrato": None}, "vibrato"), ({"palm_mute": 0}, "palm_mute"), ({"staccato": "no"}, "staccato"),
    ({"fret": True}, "fret"), ({"string": 1.5}, "string"), ({"confidence": "1"}, "confidence"), ({"fret": None}, "fret"),
]


def test_faults_of_notes(spark):
    rows = [(k, json.dumps({"measures": [{"beats": [{"notes": [{}, note]}]}]})) for k, (note, _) in enumerate(NOTES)]
    got = {r.id: r.path for r in checks.checked(spark.createDataFrame(rows, "id long, doc string"), "doc", checks.SONG).collect()}
    assert got == {k: f"measures[0].beats[0].notes[1].{field}" for k, (_, field) in enumerate(NOTES)}


@pytest.mark.parametrize("doc, want", [
    ({"measures": [{"beats": [{"notes": [{"string": 1, "bend": None, "slide": None, "vibrato": True, "confidence": 1}]}], "time": [3, 4]}], "title": "a"}, None),
    ({}, None), (None, ("", "expected JSON")), ("{", ("", "expected JSON")), ("[]", ("", "expected an object")),
    ({"tracks": [{}, {"measures": {}}]}, ("tracks[1].measures", "expected a list")),
    ({"tracks": None}, ("tracks", "expected a list")),
    ({"measures": [{"time": [4]}]}, ("measures[0].time", "expected two integers")),
    ({"measures": [{"time": [4, True]}]}, ("measures[0].time", "expected two integers")),
    ({"measures": [{"beats": [{"notes": [7]}, 3]}]}, ("measures[0].beats[0].notes[0]", "expected an object")),
    ({"tuning": [1, "x"]}, ("tuning", "expected a list of integers")),
    ({"title": None}, ("title", "expected a string")),
    ({"tempo": 1.5, "strings": "6"}, ("strings", "expected an integer")),
])
def test_faults_of_documents(spark, doc, want):
    assert first_fault(spark, doc) == want


def test_faults_of_drums(spark):
    beat = {"duration": 8, "notes": [{"step": "c", "octave": "4"}]}
    assert first_fault(spark, {"measures": [{"voices": [[beat]]}]}, checks.DRUM_SCORE) is None
    for change, where in (({"duration": 5}, ".duration"), ({"notes": [{"step": "H", "octave": 4}]}, ".notes[0].step"), ({"notes": [{"step": "C"}]}, ".notes[0].octave"), ({"tuplet": "x"}, ".tuplet")):
        assert first_fault(spark, {"measures": [{"voices": [[beat, beat | change]]}]}, checks.DRUM_SCORE)[0] == "measures[0].voices[0][1]" + where


def test_right_and_rejected_rows(spark):
    good, bad = checks.sorted_out(spark.createDataFrame([(1, "{}"), (2, '{"title": 3}')], "id long, doc string"), "doc", checks.SONG)
    assert [tuple(r) for r in good.collect()] == [(1, "{}")] and [tuple(r) for r in bad.collect()] == [(2, "title", "expected a string")]


def note_xml(i, string, fret, more=""):
    return f'<Note id="{i}">{more}<Properties><Property name="String"><String>{string}</String></Property><Property name="Fret"><Fret>{fret}</Fret></Property></Properties></Note>'


GPIF = (
    "<GPIF><Tracks><Track><Name>Bass</Name></Track><Track><Name>Lead</Name></Track></Tracks>"
    "<MasterBars><MasterBar><Time>3/4</Time><Bars>0 1</Bars></MasterBar><MasterBar><Bars>0 7</Bars></MasterBar><MasterBar><Bars>0 0</Bars></MasterBar></MasterBars>"
    '<Bars><Bar id="0"><Voices>-1 -1</Voices></Bar><Bar id="1"><Voices>-1 5 6</Voices></Bar></Bars>'
    '<Voices><Voice id="5"><Beats>2 0 2</Beats></Voice><Voice id="6"><Beats>9</Beats></Voice></Voices>'
    '<Beats><Beat id="0"><Rhythm ref="0"/></Beat><Beat id="2"><Rhythm ref="1"/><Notes>1 0</Notes></Beat></Beats>'
    "<Notes>" + note_xml(0, 2, 14, '<Tie origin="false" destination="True"/>') + note_xml(1, 0, 3, '<Tie destination="false"/><Accent>3</Accent>') + "</Notes>"
    '<Rhythms><Rhythm id="0"><NoteValue>Half</NoteValue><AugmentationDot count="2"/></Rhythm><Rhythm id="1"><PrimaryTuplet num="3" den="2"/></Rhythm></Rhythms></GPIF>'
)


def test_tracks_by_lists_of_ids(spark):
    docs = linked.parsed(spark.createDataFrame([(1, GPIF), (2, "<GPIF><Tracks>"), (3, None), (4, GPIF.replace("Lead", "Solo"))], "id long, x string"), "x")
    rows = [(r.measure, r.num, r.den, r.beat, r.listed, r.duration, r.dots, r.tuplet, r.rest, r.string, r.fret, r.tied, r.staccato) for r in linked.track_rows(docs, ["id"], "Lead").collect()]
    beat = lambda b: [(1, 3, 4, b, 0, 4, 0, 3, False, 0, 3, False, True), (1, 3, 4, b, 1, 4, 0, 3, False, 2, 14, True, False)]
    empty = [(m, 4, 4, *[None] * 10) for m in (2, 3)]
    assert sorted(map(str, rows)) == sorted(map(str, [*beat(1), (1, 3, 4, 2, None, 2, 2, None, True, *[None] * 4), *beat(3), *empty]))
    assert {r.id: r.reason for r in linked.without_track(docs, ["id"], "Lead").collect()} == {2: "not a document", 3: "not a document", 4: "no track 'Lead' in Bass, Solo"}
    assert [tuple(r) for r in linked.tracks(docs, ["id"], "Lead").collect()] == [(1, 1, [], 0, None)]


def test_attributes_in_force(spark):
    texts = [
        '<measure number="1"><attributes><divisions>2</divisions><key><fifths>1</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time><clef number="2"><sign>F</sign><line>4</line></clef></attributes>'
        "<note><duration>4</duration></note><note><chord/><duration>4</duration></note><note><duration>2</duration><voice>2</voice></note></measure>",
        "<measure", '<measure number="1"><attributes><key><fifths>1</fifths></key></attributes><note><duration>3</duration></note></measure>',
        '<measure number="2"><attributes><divisions>5</divisions></attributes><attributes><key><fifths>-2</fifths></key></attributes><note><duration>1</duration></note></measure>',
        '<measure number="3"><attributes><divisions>9999</divisions></attributes><note><duration>1</duration></note></measure>',
    ]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(texts)], "piece string, i long, x string")
    rows = [tuple(r) for r in documents.measures_in_force(df, "piece", ["i"], "x").orderBy("i").collect()]
    assert rows == [
        ("p", 0, 1, 2, 1, 3, 4, None, "F4", 3, 40320, ["divisions", "fifths", "beats", "beat_type", "clef2"]), ("p", 2, 2, 2, 1, 3, 4, None, "F4", 1, 30240, []),
        ("p", 3, 3, 5, -2, 3, 4, None, "F4", 1, 4032, ["divisions", "fifths"]), ("p", 4, 4, 9999, -2, 3, 4, None, "F4", 1, None, ["divisions"]),
    ]


def test_techniques_in_order_of_edits(spark):
    kinds = "bend double, bend_release boolean, slide string, slide_in string, hopo boolean, harmonic string, harmonic_fret double, vibrato boolean, palm_mute boolean, staccato boolean"
    notes = spark.createDataFrame([(k, 5, 1.0, True, None, None, False, "pinch", 7.0, False, False, False) for k in range(8)], f"note long, fret long, {kinds}")
    log = [
        (0, 1, "harmonic", "null"), (0, 2, "harmonic", '"natural"'), (0, 3, "harmonic", '"tap"'), (1, 1, "harmonic", '"tap"'), (2, 1, "harmonic_fret", "null"), (2, 2, "harmonic", '"tap"'),
        (3, 1, "harmonic", "null"), (4, 1, "bend", "null"), (4, 2, "hopo", "true"), (4, 3, "hopo", "1"), (5, 1, "bend", "0"), (5, 2, "loud", "1"), (5, 3, "slide", "{"), (5, 4, "bend", "12"),
        (6, 1, "harmonic", '"tap"'), (6, 2, "harmonic_fret", "36"), (9, 1, "hopo", "true"), (7, 1, "harmonic_fret", "36.5"), (7, 2, "palm_mute", "null"), (7, 3, "bend", "true"),
    ]
    checked = edits.technique_edits(spark.createDataFrame(log, "note long, seq long, kind string, value string"))
    rejects = {(r.note, r.seq): r.reason for r in checked.where("reason is not null").collect()}
    assert rejects == {(4, 3): "invalid value", (5, 1): "invalid value", (5, 2): "unknown technique", (5, 3): "not a value", (7, 1): "invalid value", (7, 2): "invalid value", (7, 3): "invalid value"}
    got = {r.note: r for r in edits.set_techniques(notes, checked, ["note"]).collect()}
    assert {k: (r.harmonic, r.harmonic_fret) for k, r in got.items()} == {
        0: ("tap", 5.0), 1: ("tap", 7.0), 2: ("tap", 12.0), 3: (None, None), 4: ("pinch", 7.0), 5: ("pinch", 7.0), 6: ("tap", 36.0), 7: ("pinch", 7.0),
    }
    assert (got[4].bend, got[4].hopo, got[5].bend, got[7].bend) == (None, True, 12.0, 1.0)


def test_techniques_on_matched_notes(spark):
    rows = [(1, 2.0, False, 2.0, True, "shift", "", True, False), (1, 2.0, True, 2.0, True, None, "shift", True, True), (1, None, True, 1.0, False, "shift", "legato", False, True)]
    df = spark.createDataFrame(rows, "p long, g_bend double, g_bend_release boolean, r_bend double, r_bend_release boolean, g_slide string, r_slide string, g_hopo boolean, r_hopo boolean")
    got = [tuple(r)[1:] for r in reports.technique_counts(df, ["p"], ["bend", "slide", "hopo"]).collect()]
    assert got == [("bend", 2, 3, 2, 1), ("slide", 2, 2, 1, 0), ("hopo", 2, 2, 1, None)]


def test_songs_of_two_tracks(spark):
    songs = spark.createDataFrame([(1, 'A "b"\n\\c', 0), (2, None, 90)], "piece long, title string, tempo long")
    tracks = spark.createDataFrame([(1, 0, None, 6, []), (1, 1, "Bass", 4, [28, 33, 38, 43])], "piece long, track long, name string, strings long, tuning array<long>")
    bars = spark.createDataFrame([(1, 0, 1, "3.1.4"), (1, 1, 3, "r.1"), (1, 1, 1, "5.2.2"), (1, 5, 9, "x")], "piece long, track long, bar long, line_ string")
    lines = sinks.song_lines(songs, tracks, bars, "piece").orderBy("piece", "track", "section", "bar").collect()
    assert [r.line_ for r in lines if r.piece == 1] == [
        '\\title "A \\"b\\" \\\\c"', "\\tempo 120", ".", '\\track "Guitar 1"', "\\staff {tabs}", "\\tuning (E4 B3 G3 D3 A2 E2)", "\\ts 4 4", "3.1.4 |", "r.1 |", "r.1",
        '\\track "Bass"', "\\staff {tabs}", "\\tuning (G2 D2 A1 E1)", "\\ts 4 4", "5.2.2 |", "r.1 |", "r.1",
    ]
    assert [r.line_ for r in lines if r.piece == 2] == ['\\title ""', "\\tempo 90", "."]


def test_rates_of_a_measure_that_is_missing(spark):
    kind = "piece long, measure long, beat long, notes array<string>, rest boolean, duration long, dots long, tuplet long"
    truth = spark.createDataFrame([(1, 1, 1, ["0:3"], False, 2, 0, None), (1, 1, 2, [], True, 2, 0, None), (1, 2, 1, ["0:x"], False, 1, 0, None)], kind)
    found = spark.createDataFrame([(1, 1, 1, ["0:3"], False, 2, 0, None), (1, 1, 2, [], True, 4, 1, 3)], kind)
    r = reports.beat_rates(truth, found, ["piece"], F.lit(60480)).first()
    assert tuple(r) == (1, 2, 1, 1, 3, 2, 1, 50.0, 66.67, 50.0, 100.0)
