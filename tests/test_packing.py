"""Pages filled from the top, against a plain loop, over many stretches."""

import random

import pytest

from scorelake.operators import ordered, packing


def loop(sizes, height, gap):
    out, page, used, any_ = [], 0, 0, False
    for s in sizes:
        need = s + (gap if any_ else 0)
        if any_ and used + need > height:
            page, used, need = page + 1, 0, s
        out.append((page, used + need - s))
        used, any_ = used + need, True
    return out


def packed(spark, pieces, height, gap, stretch):
    df = spark.createDataFrame([(p, 2 * i + 5, s) for p, sizes in pieces.items() for i, s in enumerate(sizes)], "piece long, pos long, size long")
    got: dict = {}
    for r in packing.packed_pages(df, ["piece"], "pos", "size", height, gap, stretch).orderBy("piece", "pos").collect():
        got.setdefault(r.piece, []).append((r.page, r["at"]))
    return got


@pytest.mark.parametrize("stretch, gap, cut", [(None, 10, None), (4, 10, 5), (4, 0, None)])
def test_pages(spark, monkeypatch, stretch, gap, cut):
    if cut:
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", cut)
    rng = random.Random(3)
    pieces = {p: [rng.choice([0, 1, 5, 30, 90, 101, 250]) for _ in range(rng.randrange(1, 60))] for p in range(12)}
    pieces[50], pieces[51], pieces[52] = [500], [0] * 40, [50] * 33
    assert packed(spark, pieces, 100, gap, stretch) == {p: loop(s, 100, gap) for p, s in pieces.items()}


def test_rounds_are_the_logarithm_of_the_stretches(spark, monkeypatch):
    kept, plain = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a: kept.append(1) or plain(df, *a))
    sizes = [30 + i % 2 for i in range(4000)]  # two phases that never meet
    assert packed(spark, {1: sizes}, 100, 10, 4) == {1: loop(sizes, 100, 10)}
    assert len(kept) <= 2 + 2 * 11


def test_no_items(spark):
    df = spark.createDataFrame([], "piece long, pos long, size long")
    assert packing.packed_pages(df, ["piece"], "pos", "size", 10, 1).collect() == []


def test_a_long_piece_is_aligned_in_few_jobs(spark, monkeypatch):
    """A hundred blocks to a side: as many tables as sixteen tiles take, and the pairs of one block."""
    from scorelake.operators import alignment

    kept, plain = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a: kept.append(1) or plain(df, *a))
    rng = random.Random(8)
    g = [[rng.choice("abcd") for _ in range(4)] for _ in range(200)]
    p = [m if rng.random() < 0.8 else [rng.choice("abcd")] for m in g if rng.random() < 0.9]
    rows = [spark.createDataFrame([(7, i, m) for i, m in enumerate(x)], "piece long, i long, items array<string>") for x in (g, p)]
    want = sorted(map(str, alignment.align_measures(*rows, "piece").collect()))
    assert not kept
    got = sorted(map(str, alignment.align_measures(*rows, "piece", block=2).collect()))
    assert got == want and len(want) >= 200 and len(kept) <= 16
