"""Run history, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.operators import runs as R
from docsieve.session import checkpoint_dir
from docsieve.sources import files as S
from docsieve.streaming import runs as ST


def _lines(spark, d):
    return X.run_lines(spark, d)


def j1_parse_marker(spark, d):
    marked = R.parse_marker(_lines(spark, d)).filter("kind is not null")
    time = F.date_format(R.to_time(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return marked.select("log_id", "line_no", "kind", "id", "mode", "file", "pattern", "timestamp", time.alias("time"))


_KEY = r"CASE WHEN regexp_matches(line, '[ ]{k}:') THEN regexp_extract(line, '[ ]{k}:([^ >]*)', 1) END AS {k}"
MARKERS = (
    "SELECT log_id, line_no, CASE WHEN starts_with(line, '<BEGIN ANALYSIS') THEN 'begin' ELSE 'end' END AS kind, "
    + ", ".join(_KEY.replace("{k}", k) for k in ("id", "mode", "file", "pattern", "timestamp"))
    + " FROM run_lines WHERE starts_with(line, '<BEGIN ANALYSIS') OR starts_with(line, '<END ANALYSIS')"
)
J1 = f"SELECT *, strftime(strptime(timestamp, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS time FROM ({MARKERS})"


def j2_parse_result(spark, d):
    return R.parse_result(_lines(spark, d)).select("log_id", "line_no", "result")


_JSON = "replace(replace(replace(line, '''', '\"'), 'True', 'true'), 'False', 'false')"
RESULTS = f"""SELECT log_id, line_no, {_JSON} AS result, CASE WHEN contains(line, 'white_text_analysis') THEN 'hidden_text'
    WHEN contains(line, 'predicted_category') THEN 'classification' ELSE 'turnover' END AS result_kind FROM run_lines
    WHERE starts_with(line, '{{''')"""
J2 = f"SELECT log_id, line_no, result FROM ({RESULTS})"


def j3_route_result(spark, d):
    return R.route_result(R.parse_result(_lines(spark, d))).select("log_id", "line_no", "result_kind")


J3 = f"SELECT log_id, line_no, result_kind FROM ({RESULTS})"


def j4_assign_to_run(spark, d):
    return R.assign_to_run(_lines(spark, d)).select("log_id", "line_no", "result_kind", "run_line")


# The state of each log after each marker, one step at a time.
_STEPS = f"""SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS k FROM ({MARKERS})"""
_CHILD = "(m.kind = 'end' AND s.child IS NOT NULL AND (m.id IS NULL OR m.id = s.child_id))"
_TOP = f"(m.kind = 'end' AND NOT {_CHILD} AND s.top IS NOT NULL AND (m.id IS NULL OR m.id = s.top_id))"
_INSIDE = "(m.kind = 'begin' AND m.mode = 'analyze' AND s.top IS NOT NULL)"
_STATE = f"""SELECT log_id, 0 AS k, CAST(0 AS BIGINT) AS line_no, NULL::BIGINT AS top, NULL::VARCHAR AS top_id, NULL::BIGINT AS child, NULL::VARCHAR AS child_id,
        NULL::BIGINT AS parent, NULL::BIGINT AS closes FROM (SELECT DISTINCT log_id FROM steps)
    UNION ALL SELECT m.log_id, m.k, m.line_no,
        CASE WHEN m.kind = 'begin' AND NOT {_INSIDE} THEN m.line_no WHEN {_TOP} THEN NULL ELSE s.top END,
        CASE WHEN m.kind = 'begin' AND NOT {_INSIDE} THEN m.id WHEN {_TOP} THEN NULL ELSE s.top_id END,
        CASE WHEN {_INSIDE} THEN m.line_no WHEN m.kind = 'begin' OR {_CHILD} OR {_TOP} THEN NULL ELSE s.child END,
        CASE WHEN {_INSIDE} THEN m.id WHEN m.kind = 'begin' OR {_CHILD} OR {_TOP} THEN NULL ELSE s.child_id END,
        CASE WHEN {_INSIDE} THEN s.top END,
        CASE WHEN {_CHILD} THEN s.child WHEN {_TOP} THEN s.top END
    FROM walk s JOIN steps m ON m.log_id = s.log_id AND m.k = s.k + 1"""
_WALK = f"WITH RECURSIVE steps AS ({_STEPS}), walk AS ({_STATE})"
_ASSIGNED = f"""SELECT r.log_id, r.line_no, result, result_kind, coalesce(child, top) AS run_line FROM ({RESULTS}) r
    ASOF LEFT JOIN walk w ON w.log_id = r.log_id AND r.line_no >= w.line_no"""
J4 = f"{_WALK} SELECT log_id, line_no, result_kind, run_line FROM ({_ASSIGNED})"


def _runs(spark, d):
    return R.run_status(R.assign_markers(_lines(spark, d)))


def j5_run_status(spark, d):
    return _runs(spark, d).select(
        "log_id", "run_line", "id", "mode", "file", "parent_line", "status", "start_time", "end_time", "duration_seconds"
    )


_RUNS = """SELECT b.log_id, b.line_no AS run_line, b.id, b.mode, b.file, w.parent AS parent_line,
    CASE WHEN e.line_no IS NULL THEN 'running' WHEN e.id IS NULL THEN 'error' ELSE 'completed' END AS status, b.timestamp AS start_time, e.timestamp AS end_time,
    CAST(epoch(strptime(e.timestamp, '%Y%m%d_%H%M%S')) - epoch(strptime(b.timestamp, '%Y%m%d_%H%M%S')) AS BIGINT) AS duration_seconds
    FROM steps b JOIN walk w ON w.log_id = b.log_id AND w.line_no = b.line_no
    LEFT JOIN (SELECT x.log_id, x.closes, x.line_no, s.id, CASE WHEN s.id IS NOT NULL THEN s.timestamp END AS timestamp FROM walk x JOIN steps s ON s.log_id = x.log_id AND s.line_no = x.line_no
        WHERE closes IS NOT NULL) e ON e.log_id = b.log_id AND e.closes = b.line_no
    WHERE b.kind = 'begin'"""
J5 = f"{_WALK} {_RUNS}"


def j6_latest_runs(spark, d):
    return R.latest_runs(_runs(spark, d), 25).select("log_id", "run_line", "id", "status", "start_time")


J6 = f"""{_WALK} SELECT log_id, run_line, id, status, start_time FROM ({_RUNS}) WHERE parent_line IS NULL
    ORDER BY start_time DESC, log_id DESC, run_line DESC LIMIT 25"""


def _with_results(spark, d):
    lines = _lines(spark, d)
    markers = R.assign_markers(lines)
    return R.run_results(R.run_status(markers), R.assign_to_run(lines, markers))


def j7_run_by_id(spark, d):
    """One run with its results, looked up over the whole log."""
    begun = X.table(spark, d, "events").filter("event_type = 'signup' and event_id % 40 <> 7")
    found = R.run_by_id(_with_results(spark, d), f"r{begun.agg(F.min('event_id')).first()[0]}")
    return found.select("log_id", "run_line", "id", "status", "hidden_text", "classification", "turnover")


_LAST = """SELECT log_id, run_line, arg_max(result, line_no) FILTER (result_kind = 'hidden_text') AS hidden_text,
    arg_max(result, line_no) FILTER (result_kind = 'classification') AS classification,
    arg_max(result, line_no) FILTER (result_kind = 'turnover') AS turnover FROM ({assigned}) GROUP BY log_id, run_line"""
_FULL = f"SELECT r.*, hidden_text, classification, turnover FROM ({_RUNS}) r LEFT JOIN ({_LAST.format(assigned=_ASSIGNED)}) l ON l.log_id = r.log_id AND l.run_line = r.run_line"
J7 = f"""{_WALK}, found AS ({_FULL}) SELECT log_id, run_line, id, status, hidden_text, classification, turnover FROM found
    WHERE id = (SELECT concat('r', min(event_id)) FROM events WHERE event_type = 'signup' AND event_id % 40 <> 7)"""


def j7_runs_with_results(spark, d):
    """Every run with its results."""
    return _with_results(spark, d).select("log_id", "run_line", "id", "status", "hidden_text", "classification", "turnover")


J7_ALL = f"""{_WALK}, found AS ({_FULL}) SELECT log_id, run_line, id, status, hidden_text, classification, turnover FROM found"""


def j8_batch_run_summary(spark, d):
    return R.batch_run_summary(_with_results(spark, d))


J8 = f"""{_WALK}, found AS ({_FULL}), files AS (SELECT *, CASE WHEN status = 'completed' THEN regexp_extract(classification, 'category": "(\\w+)"', 1) END AS category
        FROM found WHERE parent_line IS NOT NULL)
    SELECT b.log_id, b.run_line, b.id, b.status, coalesce(total_files, 0) AS total_files, coalesce(completed_files, 0) AS completed_files,
        coalesce(error_files, 0) AS error_files, coalesce(running_files, 0) AS running_files, coalesce(hidden_detections, 0) AS hidden_detections,
        coalesce(stuffing_detections, 0) AS stuffing_detections, coalesce(will_leave, 0) AS will_leave, coalesce(will_stay, 0) AS will_stay, top_categories
    FROM (SELECT * FROM found WHERE mode = 'batch' AND parent_line IS NULL) b
    LEFT JOIN (SELECT log_id, parent_line, count(*) AS total_files, count(*) FILTER (status = 'completed') AS completed_files,
        count(*) FILTER (status = 'error') AS error_files, count(*) FILTER (status = 'running') AS running_files, count(*) FILTER (status = 'completed' AND contains(hidden_text, 'has_white_text": true')) AS hidden_detections,
        count(*) FILTER (status = 'completed' AND contains(hidden_text, 'detected": true')) AS stuffing_detections,
        count(*) FILTER (status = 'completed' AND contains(turnover, 'true')) AS will_leave,
        count(*) FILTER (status = 'completed' AND contains(turnover, 'false')) AS will_stay FROM files GROUP BY log_id, parent_line) f
        ON f.log_id = b.log_id AND f.parent_line = b.run_line
    LEFT JOIN (SELECT log_id, parent_line, string_agg(concat(category, ':', n), ',' ORDER BY n DESC, category) AS top_categories FROM (
        SELECT log_id, parent_line, category, count(*) AS n FROM files WHERE category IS NOT NULL AND category <> '' GROUP BY log_id, parent_line, category
        QUALIFY row_number() OVER (PARTITION BY log_id, parent_line ORDER BY n DESC, category) <= 3) GROUP BY log_id, parent_line) t
        ON t.log_id = b.log_id AND t.parent_line = b.run_line"""


def replay(spark, lines, run):
    """Writes ``lines`` to a folder, streams them through ``run`` to the end and returns what came out as a table."""
    base = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    lines.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{base}/in")
    query = (
        run(stream)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _far_mark(lines):
    """A last line far in the future, so that the watermark passes everything before it."""
    spark = lines.sparkSession
    row = "select cast(-1 as bigint) log_id, cast(1 as bigint) line_no, timestamp'2034-01-01 00:00:00' ts, '<END ANALYSIS id:none timestamp:0>' line"
    return spark.sql(row).select(*lines.columns)


def j9_stream_runs(spark, d):
    """All runs of a streamed log: those it completes, and those left open, which a line far ahead lets time out."""
    lines = _lines(spark, d)
    out = replay(spark, lines.unionByName(_far_mark(lines)), ST.stream_runs)
    return out.select("log_id", "run_line", "id", "mode", "parent_line", "status", "start_time", "end_time", "duration_seconds")


J9 = f"""{_WALK} SELECT log_id, run_line, id, mode, parent_line, status, start_time, end_time, duration_seconds FROM ({_RUNS})"""


SEGMENT_LINES = 40
#: Files of a micro-batch at least, and how many micro-batches there are at most for any number of files beyond that.
SEGMENT_FILES, SEGMENT_STEPS = 1000, 8
#: Where Spark writes the segments of a log.
SEGMENT_FOLDER = r"log_id=([^/]+)/segment=0*(\d+)/[^/]*$"


def j9_stream_segments(spark, d):
    """All runs of logs that come as text segments, the newest files first: each log's last segment is read before its first."""
    base = f"{checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    number = F.floor((F.col("line_no") - 1) / SEGMENT_LINES) + 1
    lines = _lines(spark, d).select("log_id", number.alias("segment"), "line_no", "line")
    for turn in (0, 1):  # even segments are written before odd ones
        S.write_line_files(lines.filter(F.col("segment") % 2 == turn), f"{base}/in", ["log_id", "segment"], ["line_no"])
    end = spark.sql("select -1 as log_id, 1 as segment, '<END ANALYSIS id:none timestamp:20940101_000000>' as line")
    end.write.mode("append").partitionBy("log_id", "segment").text(f"{base}/in")  # the last file: what is open times out
    written = lines.select("log_id", "segment").distinct().count()
    segments = S.stream_log_segments(spark, f"{base}/in", files=max(SEGMENT_FILES, -(-written // SEGMENT_STEPS)), pattern=SEGMENT_FOLDER)
    query = (
        ST.stream_segment_runs(segments, delay="18000 days")
        .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    named = S.read_log_segments(spark, f"{base}/in", SEGMENT_FOLDER).select("log_id", "log").distinct()
    out = spark.read.parquet(f"{base}/out").join(named, "log_id")
    return out.select(F.col("log").cast("bigint").alias("log_id"), "run_line", "id", "mode", "parent_line", "status", "start_time", "end_time", "duration_seconds")


def j10_stream_batch_counts(spark, d):
    """Windows that a watermarked stream closes; a last line far ahead closes all of the log's."""
    lines = _lines(spark, d)
    mark = _far_mark(lines).withColumn("line", F.lit("{'prediction': 1}"))
    out = replay(spark, lines.unionByName(mark), ST.stream_batch_counts)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "result_kind", "n", "flagged")


J10 = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, result_kind, count(*) AS n,
    count(*) FILTER (contains(result, 'has_white_text": true') OR contains(result, 'will_leave": true')) AS flagged
    FROM ({RESULTS}) r JOIN run_lines USING (log_id, line_no) GROUP BY ALL"""


def j10_batch_counts(spark, d):
    out = ST.batch_counts(_lines(spark, d))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "result_kind", "n", "flagged")


def j10_log_sessions(spark, d):
    out = ST.log_sessions(_lines(spark, d))
    return out.select("log_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


J10_SESSIONS = """SELECT log_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS session FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY log_id ORDER BY line_no) >= INTERVAL 12 HOUR, true) AS gap FROM run_lines))
    GROUP BY log_id, session"""

QUERIES = {
    "j1_parse_marker": j1_parse_marker,
    "j2_parse_result": j2_parse_result,
    "j3_route_result": j3_route_result,
    "j4_assign_to_run": j4_assign_to_run,
    "j5_run_status": j5_run_status,
    "j6_latest_runs": j6_latest_runs,
    "j7_run_by_id": j7_run_by_id,
    "j7_runs_with_results": j7_runs_with_results,
    "j8_batch_run_summary": j8_batch_run_summary,
    "j9_stream_runs": j9_stream_runs,
    "j9_stream_segments": j9_stream_segments,
    "j10_stream_batch_counts": j10_stream_batch_counts,
    "j10_batch_counts": j10_batch_counts,
    "j10_log_sessions": j10_log_sessions,
}
ORACLE = {
    name: X.oracle(sql)
    for name, sql in {
        "j1_parse_marker": J1,
        "j2_parse_result": J2,
        "j3_route_result": J3,
        "j4_assign_to_run": J4,
        "j5_run_status": J5,
        "j6_latest_runs": J6,
        "j7_run_by_id": J7,
        "j7_runs_with_results": J7_ALL,
        "j8_batch_run_summary": J8,
        "j9_stream_runs": J9,
        "j9_stream_segments": J9,
        "j10_stream_batch_counts": J10,
        "j10_batch_counts": J10,
        "j10_log_sessions": J10_SESSIONS,
    }.items()
}
