"""Incremental operators, each usable on a stream and, with the same result, on a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codemill.settings import EVENT_RING, SESSION_MINUTES
from codemill.sources.chunk_table import ChunkTable


def coalesced(changes: DataFrame) -> DataFrame:
    """Of changes (project, filePath, event, ts) the last of each file: what came before it does not count."""
    return changes.groupBy("project", "filePath").agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.max("ts").alias("ts"))


def watch(changes: DataFrame, table: ChunkTable, read: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a stream of changes (project, filePath, event: add, change or unlink, ts) to the code table, batch by batch.

    read gives the records of the files of a batch. Each batch is one replacement of whole files, so that a batch which runs
    again after a failure leaves the same table; one writer runs at a time."""

    def apply(batch: DataFrame, _: int) -> None:
        last = coalesced(batch).persist()
        if not last.isEmpty():
            table.replace(read(last.where("event <> 'unlink'").select("project", "filePath")), last.select("project", "filePath"))
        last.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_window(events: DataFrame, time: str, by: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, by, events: tumbling windows, or sliding ones; late is how long rows may be late on a stream."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), by, "events")


def sessions(beats: DataFrame, time: str, by: str, minutes: int = SESSION_MINUTES, late: str | None = None) -> DataFrame:
    """by, session_start, session_end (minutes after its last beat), beats: a session ends after minutes of silence."""
    rows = beats.withWatermark(time, late) if late else beats
    out = rows.groupBy(F.session_window(time, f"{minutes} minutes").alias("w"), by).agg(F.count("*").alias("beats"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "beats")


def ring(events: DataFrame, since: int = 0, capacity: int = EVENT_RING) -> DataFrame:
    """The newest capacity events (id, ...) behind a cursor, by id; a cursor beyond the last id starts anew, as after a restart."""
    newest = events.orderBy(F.col("id").desc()).limit(capacity)
    last = F.max("id").over(Window.partitionBy(F.lit(1)))
    return newest.withColumn("_last", last).where((F.col("id") > since) | (F.col("_last") < since)).drop("_last")


def ringed(events: DataFrame, by: str, capacity: int = EVENT_RING) -> DataFrame:
    """A stream of rings: by, lastId, held and the oldest id of the newest capacity events (by, id) of each group."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for part in parts:
            held += part["id"].tolist()
        held = sorted(set(held))[-capacity:]
        state.update((held,))
        yield pd.DataFrame({by: [key[0]], "lastId": [held[-1]], "held": [len(held)], "oldest": [held[0]]})

    kind = dict(events.dtypes)[by]
    return events.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, lastId long, held int, oldest long", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def notifications(events: DataFrame) -> DataFrame:
    """event rows (id, type, project, jobType, status) with the resource that a client should read again, null for none."""
    name = F.when(F.col("type").isin("job-completed", "job-failed", "job-queued", "job-started"), F.lit("jobs")).when(F.col("type").isin("index-updated", "index-removed", "index-created"), F.concat(F.lit("index/"), F.coalesce("project", F.lit("*")))).when(F.col("type") == "doccheck-updated", F.concat(F.lit("doccheck/"), F.coalesce("project", F.lit("*"))))
    return events.withColumn("resource", name)


class Revisions:
    """Derived tables by revision of what they come from: a write makes the next revision, and older results are let go."""

    def __init__(self) -> None:
        self.revision: dict[str, int] = {}
        self._held: dict[tuple[str, str], tuple[int, DataFrame]] = {}

    def written(self, project: str) -> None:
        self.revision[project] = self.revision.get(project, 0) + 1

    def derived(self, project: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        now, key = self.revision.get(project, 0), (project, name)
        if key in self._held and self._held[key][0] == now:
            return self._held[key][1]
        if key in self._held:
            self._held.pop(key)[1].unpersist()
        self._held[key] = now, make().persist()
        return self._held[key][1]


def retried(items: list, run: Callable[[list], None], failed: Callable[[object, Exception], None]) -> None:
    """Runs a batch; where it fails, each item by itself, and each that fails once more."""
    try:
        run(items)
        return
    except Exception:  # noqa: BLE001 - any failure of the batch sends its items one by one
        rest = []
        for item in items:
            try:
                run([item])
            except Exception:  # noqa: BLE001
                rest.append(item)
        for item in rest:
            try:
                run([item])
            except Exception as e:  # noqa: BLE001
                failed(item, e)
