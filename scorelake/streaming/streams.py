"""Structured Streaming forms: folds with keyed state, sampling, cells, sessions, changes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scorelake.operators.fold import Fold, _frame
from scorelake.session import checkpoint_folder

c = F.col


#: Stands for the end of a stream: no row is later.
END_MS = int(datetime(2150, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


@dataclass(frozen=True)
class Ending:
    """Rows of a stream with a mark, a second source that tells when there are no more. ``close`` puts one row there,
    later than any other; the next run then passes everything that is still held."""

    rows: DataFrame
    folder: str
    ts: str
    delay_ms: int

    def close(self) -> None:
        spark, at = self.rows.sparkSession, F.timestamp_millis(F.lit(END_MS + self.delay_ms).cast("long"))
        given = {self.ts: at, "_end": F.lit(True)}
        one = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.rows.schema]
        spark.range(1).select(*one).write.mode("append").parquet(self.folder)


def with_end(df: DataFrame, ts: str, delay_ms: int) -> Ending:
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/ends-{uuid.uuid4().hex}"
    rows = df.withColumn("_end", F.lit(None).cast("boolean"))
    spark.createDataFrame([], rows.schema).write.parquet(folder)
    marks = spark.readStream.schema(rows.schema).parquet(folder)
    return Ending(rows.unionByName(marks).withWatermark(ts, f"{delay_ms} milliseconds"), folder, ts, delay_ms)


class FoldProcessor(StatefulProcessor):
    """A fold with its state in the store. Time is cut into cells; the rows that a batch has for a cell are one entry of
    a map, and a key has one timer, at the end of its first cell or where time alone ends something. So a batch writes
    an entry per key and cell that it has rows of, and reads those cells that are over, all at once."""

    def __init__(self, unit_ms: int, cell_ms: int, cols: Sequence[str], make: Callable[[str | None], Fold], key: str, names: Sequence[str]):
        self.unit_ms, self.cell_ms, self.cols, self.make, self.key, self.names = unit_ms, cell_ms, list(cols), make, key, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell bigint, part bigint", "rows string")
        self.held = handle.getValueState("held", "cells string")  # parts by cell, and the timer
        self.fold = handle.getValueState("fold", "state string")

    def _hold(self, cells: dict[int, int], at: int, now: int, before: int | None) -> None:
        """Keeps the parts of the cells and the one timer, at ``at`` or right after ``now``."""
        at = min(max(at, now + 1), END_MS - 1)
        if at != before:
            if before is not None and before > now:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        self.held.update((json.dumps([at, sorted(cells.items())]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), {}
        for pdf in rows:
            for end, *r in zip(*[pdf[x].tolist() for x in ("is_end", *self.cols)], strict=True):
                if end is True:
                    continue
                new.setdefault(int(r[0]) * self.unit_ms // self.cell_ms, []).append(r)
        if not new:
            return iter(())
        known = self.held.get()
        before, cells = json.loads(known[0]) if known else (None, [])
        cells = dict(cells)
        for cell, found in new.items():
            part = cells.get(cell, 0)
            self.waiting.updateValue((cell, part), (json.dumps(found),))
            cells[cell] = part + 1
        first = (min(new) + 1) * self.cell_ms
        self._hold(cells, first if before is None else min(first, before), now, before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All cells that are over, in order: their rows are sorted and folded, then what time alone ends."""
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        known = self.held.get()
        if not known:
            return iter(())
        over, ended = now // self.cell_ms, now >= END_MS - 1
        cells = dict(json.loads(known[0])[1])
        due = sorted(x for x in cells if ended or x < over)
        state = self.fold.get()
        f, out = self.make(state[0] if state else None), []
        for cell in due:
            parts = [(cell, part) for part in range(cells.pop(cell))]
            for r in sorted(r for p in parts for r in json.loads(self.waiting.getValue(p)[0])):
                out += f.row(*r)
            if cells:
                for p in parts:
                    self.waiting.removeKey(p)
        if not cells:
            self.waiting.clear()
        if ended:
            out += f.end()
            self.fold.clear()
            self.held.clear()
        else:
            finished, again = f.tick(over * self.cell_ms // self.unit_ms)
            out += finished
            self.fold.update((f.state(),))
            ends = [(x + 1) * self.cell_ms for x in cells]
            if again is not None:
                ends.append(-(-int(again) * self.unit_ms // self.cell_ms) * self.cell_ms)
            self._hold(cells, min(ends, default=END_MS), now, at)
        return iter([_frame([(*key, *o) for o in out], self.names)]) if out else iter(())

    def close(self) -> None:
        pass


#: The least width of a cell of time, in milliseconds.
CELL_MS = 3_600_000


def stream_fold(
    source: Ending, key: str, unit_ms: int, cols: Sequence[str], make: Callable[[str | None], Fold], schema: str,
    cell_ms: int = CELL_MS,
) -> DataFrame:
    """A fold over an unordered stream. Rows wait in the state until the watermark passes them, are sorted and folded.
    ``cols`` starts with the time in whole units of ``unit_ms`` and lists values in sort order. Rows are folded by cells
    of time, as wide as a quarter of the delay and ``cell_ms`` at least, so that much later than the delay asks. Timers
    let time alone finish things, and the end of the stream finishes what is open. Run it with :func:`run_to_table`."""
    names = [key, *[p.strip().split(" ")[0] for p in schema.split(",")]]
    kinds = dict(source.rows.dtypes)
    rows = source.rows.select(key, *[x for x in dict.fromkeys([*cols, source.ts]) if x != key], c("_end").alias("is_end"))  # names with a leading underscore don't reach Python here
    cell = -(-max(cell_ms, source.delay_ms // 4) // unit_ms) * unit_ms
    return rows.groupBy(key).transformWithStateInPandas(
        FoldProcessor(unit_ms, cell, cols, make, key, names), f"{key} {kinds[key]}, {schema}", "append", "EventTime"
    )


def stream_sample(source: Ending, keys: Sequence[str], cell: str, order: Sequence[str]) -> DataFrame:
    """First row per key and grid cell by ``order``, whatever order rows arrive in; a cell is kept until the watermark
    has passed its end."""
    names = [n for n in source.rows.columns if n != "_end"]
    cells = source.rows.groupBy(*keys, F.window(source.ts, cell).alias("_cell"))
    return cells.agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")


def tumbling(df: DataFrame, keys: Sequence[str], ts: str, width: str) -> DataFrame:
    """Rows per key and cell of fixed width; works on tables and, with a watermark, on streams."""
    return df.groupBy(*keys, F.window(ts, width).alias("_w")).agg(F.count("*").alias("n")).select(
        *keys, c("_w.start").alias("start"), "n"
    )


def sessions(df: DataFrame, keys: Sequence[str], ts: str, ttl: str) -> DataFrame:
    """Runs of rows no further apart than ``ttl``."""
    return df.groupBy(*keys, F.session_window(ts, ttl).alias("_w")).agg(
        F.count("*").alias("n"), F.max(ts).alias("last_ts")
    ).select(*keys, c("_w.start").alias("start"), "last_ts", "n")


def rerendered(
    before: DataFrame, inputs: DataFrame, changed: DataFrame, key: Sequence[str], render: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Results after a change of settings: only the changed keys are worked out again."""
    again = render(inputs.join(changed.select(*key).distinct(), [*key], "left_semi"))
    kept = before.join(changed.select(*key).distinct(), [*key], "left_anti")
    return kept.unionByName(again)


def on_changes(
    changes: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str
):
    """Streams changed keys; each batch is worked out once and written under its batch number,
    so a repeated batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def disorder_ms(rows: DataFrame, ts: str) -> int:
    """How far rows of a table's files are behind rows of the same or an earlier file, in the order in which a stream
    reads them: a delay with which none is late. One row per file is kept."""
    f = rows.select(c("_metadata.file_path").alias("file"), c("_metadata.file_modification_time").alias("at"), c(ts).alias("ts"))
    f = f.groupBy("file", "at").agg(F.min("ts").alias("least"), F.max("ts").alias("most")).groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    seen = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    behind = F.unix_millis(F.max("most").over(seen)) - F.unix_millis("least")
    return (f.select(behind.alias("d")).agg(F.max("d")).first()[0] or 0) + 1


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream, one file per step."""
    # as a pattern, so that a single file is taken too
    glob = path if any(x in path for x in "*[?{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(glob)


#: The store of keyed state that has lists, maps and timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def state_store(spark: SparkSession):
    """While a stream is started: the store that keyed folds need, and then what was set before."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(df: DataFrame, source: Ending | None = None) -> DataFrame:
    """Runs a stream over all there is, ends ``source`` and reads back what was written. Rows that were dropped as late
    are an error."""
    spark = df.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    @state_store(spark)
    def run() -> None:
        query = (
            df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        if late:
            raise ValueError(f"{late} rows came later than the delay allows")

    run()
    if source is not None:
        source.close()
        run()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
