"""Every query with SQL gives the same rows; the others run and give rows."""

import pytest
from conftest import SMALL, as_rows

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# cut keys go through the carried values: one query per kind of scan and fold
CUT = [
    "seq5_segments", "seq6_even_picks", "seq9_merge_adjacent_exact", "seq12_highlight_periods", "seq14_overlap_strips",
    "seq16_anchored_columns", "jn6_nearest_with_tolerance", "jn14_groups_in_extents", "jn17_consecutive_pairs",
    "win4_held_notes", "win9_changed_attributes", "win10_measure_starts", "win11_delta_time", "win15_next_flagged",
    "agg10_typical_value", "agg11_filled_numbers", "udf3_page_packing", "ed6_insert_and_delete", "str3_segments",
]


def check(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert as_rows(df.columns, got) == as_rows(names, cur.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    check(name, spark, duck)


@pytest.mark.parametrize("name", CUT)
def test_same_rows_when_keys_are_cut(name, spark, duck, tiny_chunks):
    check(name, spark, duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert df.limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["vid", "seg", "start_us", "end_us", "n"]
