"""Run history and counters kept up to date over an appended log."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docsieve.operators.runs import advance, marker_struct, parse_marker, parse_result, route_result

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = (
    "log_id bigint, run_line bigint, id string, mode string, parent_line bigint, status string, "
    "start_time string, end_time string, duration_seconds bigint"
)
_RUN = "line bigint, id string, mode string, parent bigint, start string"
_STATE = f"top struct<{_RUN}>, child struct<{_RUN}>"


def _seconds(start: str | None, end: str | None) -> int | None:
    try:
        span = pd.to_datetime(end, format="%Y%m%d_%H%M%S") - pd.to_datetime(start, format="%Y%m%d_%H%M%S")
        return int(span.total_seconds())
    except (TypeError, ValueError):
        return None


class Run(NamedTuple):
    """A run that is open: where it begins, what it is called and is part of."""

    line: int
    id: str | None
    mode: str | None
    parent: int | None
    start: str | None

    def left(self, log_id: int, status: str, end: str | None = None) -> tuple:
        seconds = _seconds(self.start, end) if status == "completed" else None
        return log_id, self.line, self.id, self.mode, self.parent, status, self.start, end, seconds


class Marker(NamedTuple):
    line_no: int
    kind: str
    id: str | None
    mode: str | None
    timestamp: str | None


def _step(log_id: int, top: Run | None, child: Run | None, marker: Marker) -> tuple[Run | None, Run | None, list[tuple]]:
    """The open run and file after a marker, and the runs that it ends or replaces."""
    at = tuple((r.line, r.id) if r is not None else (None, None) for r in (top, child))
    after, (parent, closes, status) = advance(at, marker.kind, marker.id, marker.mode, marker.line_no)
    known = {r.line: r for r in (top, child) if r is not None}
    if marker.kind == "begin":
        known[marker.line_no] = Run(marker.line_no, marker.id, marker.mode, parent, marker.timestamp)
    new_top, new_child = (known.get(line) for line, _ in after)
    gone = []
    for line, run in known.items():
        if run is not new_top and run is not new_child:
            how = status if line == closes else "running"
            gone.append(run.left(log_id, how, marker.timestamp if how == "completed" else None))
    return new_top, new_child, gone


def _frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    return found.astype({"parent_line": "Int64", "duration_seconds": "Int64"})


def _follow(timeout_ms: int):
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        """Open runs of one log are the whole state; every run that ends or is replaced is given out once."""
        log_id = int(key[0])
        top, child = (None if r is None else Run(*r) for r in (state.get if state.exists else (None, None)))
        latest = 0
        out = []
        if state.hasTimedOut:
            out += [run.left(log_id, "running") for run in (child, top) if run is not None]
            state.remove()
        else:
            # Arrow cuts a log's lines of a micro-batch where it likes; their order counts over the cuts
            arrived = pd.concat(list(batches)).sort_values("line_no")
            if len(arrived):
                latest = max(latest, int(arrived["at_ms"].max()))
                for row in arrived.itertuples(index=False):
                    top, child, gone = _step(log_id, top, child, Marker(row.line_no, row.kind, row.id, row.mode, row.timestamp))
                    out += gone
            if (top, child) == (None, None):
                if state.exists:
                    state.remove()
            else:
                state.update((top, child))
                # Counted from the log's own last marker: the watermark is still at zero in the first micro-batch.
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), latest) + timeout_ms)
        if out:
            yield _frame(out)

    return follow


def stream_runs(lines: DataFrame, delay: str = "1 hour", timeout: str = "7 days") -> DataFrame:
    """Finished runs of a stream of ``log_id, line_no, ts, line``; runs left open are given as running on timeout.

    Lines of one log may come in any order within a micro-batch, and micro-batches in order; lines older than the watermark
    are dropped. A task holds the markers that one log has in one micro-batch.
    """
    markers = parse_marker(lines.withWatermark("ts", delay)).filter("kind is not null")
    at = F.unix_millis("ts").alias("at_ms")
    chosen = markers.select("log_id", "line_no", "ts", at, "kind", "id", "mode", "timestamp")
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return chosen.groupBy("log_id").applyInPandasWithState(
        _follow(timeout_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


class SegmentRuns(StatefulProcessor):
    """Follows one log segment by segment.

    State: the next segment and line number, the open run and file (``open``); segments that came before their turn, by
    number (``early``). A timer, set from the log's own last marker, gives up what stays open. A task holds one segment's
    markers at a time, whatever the length of the log.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "segment bigint, line bigint, latest bigint, top string, child string")
        self.early = handle.getMapState("early", "segment bigint", "n_lines bigint, at_ms bigint, markers string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log_id = int(key[0])
        segment, line, latest, top, child = self.open.get() if self.open.exists() else (1, 0, 0, None, None)
        top, child = (None if r is None else Run(*json.loads(r)) for r in (top, child))
        before = latest
        out = []

        def follow(n_lines: int, at_ms: int, markers: str) -> None:
            nonlocal segment, line, latest, top, child
            for m in json.loads(markers):
                marker = Marker(line + m["k"], m["kind"], m.get("id"), m.get("mode"), m.get("timestamp"))
                top, child, gone = _step(log_id, top, child, marker)
                out.extend(gone)
            segment, line, latest = segment + 1, line + n_lines, max(latest, at_ms)

        for batch in rows:
            for row in batch.sort_values("segment").itertuples(index=False):
                if row.segment > segment:
                    self.early.updateValue((int(row.segment),), (int(row.n_lines), int(row.at_ms), row.markers))
                elif row.segment == segment:  # one that was followed before comes again: nothing new
                    follow(int(row.n_lines), int(row.at_ms), row.markers)
                while self.early.containsKey((segment,)):
                    turn = segment
                    follow(*self.early.getValue((turn,)))
                    self.early.removeKey((turn,))
            if out:
                yield _frame(out)
                out = []
        self.open.update((segment, line, latest, *(None if r is None else json.dumps(r) for r in (top, child))))
        if latest > before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            if top is not None:
                self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            segment, line, latest, top, child = self.open.get()
            out = [Run(*json.loads(r)).left(int(key[0]), "running") for r in (child, top) if r is not None]
            self.open.update((segment, line, latest, None, None))
            if out:
                yield _frame(out)

    def close(self) -> None:
        pass


def segment_markers(segments: DataFrame) -> DataFrame:
    """log_id, segment, n_lines, ts, at_ms, markers of segments (log_id, segment, written, text), each by itself.

    ``markers`` is JSON: place ``k`` in the segment from 1, kind and values. ``ts`` is the time of the last marker that has
    one, else when the file was written; it drives the watermark.
    """
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), "\r?\n")
    marked = F.filter(F.transform(lines, marker_struct), lambda m: m["kind"].isNotNull())
    cut = segments.select("log_id", "segment", "written", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(lines).alias("lines"), marked.alias("markers"))
    last = F.array_max(F.transform("markers", lambda m: m["time"]))
    rows = cut.withColumn("ts", F.coalesce(last, "written"))
    return rows.select("log_id", "segment", F.size("lines").cast("bigint").alias("n_lines"), "ts", F.unix_millis("ts").alias("at_ms"), F.to_json("markers").alias("markers"))


def stream_segment_runs(segments: DataFrame, delay: str = "1 day", timeout: str = "7 days") -> DataFrame:
    """Runs of a stream of log segments (``sources.files.stream_log_segments``), numbered as lines of the whole log.

    Each segment is read and parsed on its own; a log's state takes the segments' markers in the order of their numbers.
    Segments may come in any order and in any micro-batch, as long as they are not older than the watermark; those that are
    ahead wait in the state, those that come again are passed over. A run is given out once: when it ends or is replaced,
    or as running when nothing has come for ``timeout``. Several kinds of state need Spark's RocksDB store, which this sets
    for the session.
    """
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = segment_markers(segments).withWatermark("ts", delay)
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return rows.groupBy("log_id").transformWithStateInPandas(SegmentRuns(timeout_ms), _OUT, "append", "EventTime")


def batch_counts(lines: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Result lines per kind and time window; the same for tables and, with a watermark, for streams."""
    results = route_result(parse_result(lines)).filter("result_kind is not null")
    hidden = F.get_json_object("result", "$.white_text_analysis.has_white_text") == "true"
    leave = F.get_json_object("result", "$.prediction.will_leave") == "true"
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = results.groupBy(frame.alias("w"), "result_kind").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(hidden | leave, hidden, leave)).alias("flagged"),
    )
    return counted.select(F.col("w.start").alias("window_start"), "result_kind", "n", "flagged")


def stream_batch_counts(lines: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    return batch_counts(lines.withWatermark("ts", delay), window, slide)


def log_sessions(lines: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Bursts of activity per log."""
    frame = F.session_window("ts", gap)
    return lines.groupBy("log_id", frame.alias("w")).agg(F.count("*").alias("n")).select(
        "log_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
