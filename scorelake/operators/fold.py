"""True sequential folds over the ordered rows of a key, without a task per key.

A fold is a small Python object that takes rows one by one and whose whole memory fits in a
short text (``state``). Keys are cut into chunks as in :mod:`ordered`; every chunk is folded on
its own, starting from nothing, and hands its final state on. Chunks whose real incoming state
differs from the one they were folded with are folded again, until none does. Most folds forget
their past after a few rows, so one or two rounds settle all chunks; the result is exact in any
case. States are small tables and are checkpointed between rounds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ordered import CHUNK, LAST, WHOLE, chunked, spread_over, tasks_of
from scorelake.session import checkpoint_folder


class Fold:
    """Base of all folds: override ``row`` and, where there is something left, ``end``."""

    def __init__(self, state: str | None = None):
        self.s = json.loads(state) if state else self.fresh()

    def fresh(self):
        return None

    def row(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []

    def tick(self, now) -> tuple[list[tuple], float | None]:
        """What time alone finishes at ``now``, and when to ask again (streams only)."""
        return [], None

    def state(self) -> str:
        return json.dumps(self.s, sort_keys=True)


def _groups(batches: Iterator[pd.DataFrame], nkeys: int, make: Callable[[str | None], Fold]):
    """Feeds sorted rows to folds; yields ``(key, last, used, fold, rows out)`` in batches."""
    at, fold, last, used, out = None, None, True, None, []
    for pdf in batches:
        columns = [pdf.iloc[:, i].tolist() for i in range(pdf.shape[1])]
        for values in zip(*columns, strict=True):
            key = values[: nkeys + 1]
            if key != at:
                if fold is not None:
                    yield at, last, used, fold, out
                at, last, used = key, values[nkeys + 1], values[nkeys + 2]
                used = used if isinstance(used, str) else None
                fold, out = make(used), []
            out += fold.row(*values[nkeys + 3 :])
            if len(out) > 50_000:
                yield at, None, used, fold, out
                out = []
    if fold is not None:
        yield at, last, used, fold, out


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    make: Callable[[str | None], Fold],
    schema: str,
    rows: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Folds the rows of each key in order; ``make(state)`` builds the fold, which gets the
    values of ``cols`` and returns rows of ``schema`` (without the keys). ``keep`` adds the number of the chunk
    that gave a row."""
    keys, order, cols = list(keys), list(order), list(cols)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    nkeys = len(keys)
    nhead = nkeys + keep
    names = [*keys, *[CHUNK] * keep, *[p.strip().split(" ")[0] for p in schema.split(",")]]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[tuple] = []
        for at, last, _used, f, out in _groups(batches, nkeys, make):
            key = at[:nhead]
            pending += [(*key, *o) for o in out]
            for o in f.end() if last else ():
                pending.append((*key, *o))
                if len(pending) > 20_000:
                    yield _frame(pending, names)
                    pending = []
            if len(pending) > 20_000:
                yield _frame(pending, names)
                pending = []
        yield _frame(pending, names)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = [
            (*at, used, f.state())
            for at, last, used, f, _out in _groups(batches, nkeys, make)
            if last is not None
        ]
        yield _frame(done, [*keys, CHUNK, "_used", "_out"])

    cut = chunked(df, keys, order, rows)
    whole, tasks = WHOLE in cut.columns, tasks_of(cut)
    if whole:
        cut = cut.withColumns({CHUNK: F.lit(-1), LAST: F.lit(True)})
    fields = [*keys, CHUNK, LAST]
    base = cut.select(*fields, *dict.fromkeys([*order, *cols]))

    def laid_out(d: DataFrame, most: int = 0) -> DataFrame:
        spread = spread_over(d, [*keys, CHUNK], most).sortWithinPartitions(*keys, CHUNK, *order)
        return spread.select(*fields, "_in", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)])

    out_schema = f"{key_types}, {CHUNK} int, {schema}" if keep else f"{key_types}, {schema}"
    no_state = F.lit(None).cast("string").alias("_in")
    if whole:
        return laid_out(base.select("*", no_state)).mapInPandas(emit, out_schema)

    checkpoint_folder(df.sparkSession)
    end_schema = f"{key_types}, {CHUNK} int, _used string, _out string"
    split = base.where(F.col(CHUNK) >= 0)
    ends = laid_out(split.select("*", no_state), tasks).mapInPandas(finish, end_schema).checkpoint()
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    while True:
        need = ends.select(*keys, CHUNK, "_used", F.lag("_out").over(over).alias("_in"))
        todo = need.where(~F.col("_in").eqNullSafe(F.col("_used"))).select(*keys, CHUNK, "_in")
        if todo.isEmpty():
            break
        again = laid_out(split.join(F.broadcast(todo), [*keys, CHUNK]), tasks).mapInPandas(finish, end_schema)
        ends = ends.join(todo, [*keys, CHUNK], "left_anti").unionByName(again).checkpoint()
    states = ends.select(*keys, CHUNK, F.col("_used").alias("_in"))
    ready = base.join(F.broadcast(states), [*keys, CHUNK], "left")
    out = laid_out(ready).mapInPandas(emit, out_schema)
    return out.withMetadata(CHUNK, {"tasks": tasks}) if keep else out


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    if not rows:
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
    return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(names, zip(*rows, strict=True), strict=True)})
