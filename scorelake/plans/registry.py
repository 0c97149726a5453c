"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The views of scorelake.sources.tables, written independently as plain SQL.
VIEWS: dict[str, str] = {
    "v_frames": """select user_id vid, event_id,
        epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) t_us, value, event_type
        from events""",
    "v_vec": "select vec_id, vec_id // 50 vid, embedding, label from embeddings",
    "v_boxes": """select l_orderkey frame, cast(l_linenumber as bigint) line_, l_partkey item,
        l_partkey % 400 x0, l_partkey % 400 + 5 + cast(floor(l_quantity) as bigint) x1,
        l_suppkey supp, l_discount conf from lineitem""",
    "v_notes": """select piece, (pos - 1) // 4 + 1 measure, (pos - 1) % 4 // 2 + 1 beat, * exclude (piece)
        from (select l_orderkey piece, row_number() over (partition by l_orderkey order by
          l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount,
          l_tax, l_returnflag, l_linestatus) pos,
        substr('CDEFGAB', cast(1 + l_partkey % 7 as int), 1) step, 4 + l_suppkey % 3 octave,
        cast(floor(l_quantity) as bigint) % 3 - 1 alter_, l_returnflag = 'R' tied,
        cast(1 as bigint) << (l_partkey % 6) duration, cast(l_linenumber % 2 as bigint) dots,
        cast(case when l_suppkey % 4 = 0 then 3 end as bigint) tuplet, l_partkey % 6 string_,
        l_suppkey % 25 fret, l_discount conf, l_partkey partkey, l_suppkey suppkey,
        cast(l_linenumber as bigint) linenumber, cast(floor(l_quantity) as bigint) qty
        from lineitem)""",
    "v_rec": """select * replace (case when partkey % 13 = 0 then fret + 1 else fret end as fret,
        case when partkey % 11 = 0 then string_ + 1 else string_ end as string_)
        from v_notes where partkey % 17 <> 0""",
    "v_numbers": """select distinct l_orderkey piece, cast(l_linenumber as bigint) number
        from lineitem""",
    "v_drum": """select p_partkey note_id, substr('CDEFGAB', cast(1 + p_partkey % 7 as int), 1) step,
        4 + p_partkey % 2 octave, case p_size % 4 when 0 then 'x' when 1 then 'circle-x'
        when 2 then 'hollow' else 'normal' end notehead, p_size % 5 = 0 open_,
        cast(p_size as bigint) size_ from part""",
    "v_systems": """select conv_id piece, turn seq, role attr,
        cast(case when turn % 3 = 0 then length(text) % 5 - 2 end as bigint) fifths,
        cast(length(text) as bigint) chars from conversations""",
    "v_edits": """select o_custkey piece, o_orderkey seq, o_custkey % 7 target, o_orderstatus op,
        cast(floor(o_totalprice) as bigint) % 30 value_ from orders""",
}
NEEDS = {"v_rec": ["v_notes"]}


def sql(views: str, *parts: str) -> str:
    """``with`` the named views and the named sub-queries (all but the last of ``parts``)."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    ctes = [f"{n} as ({VIEWS[n]})" for n in names] + list(parts[:-1])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + parts[-1]


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return keep
