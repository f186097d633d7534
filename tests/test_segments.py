"""A log written as numbered text segments, streamed in steps and out of order."""

import shutil

from test_run_states import NOTHING, tangled

from docsieve.operators import runs as R
from docsieve.sources import files as A
from docsieve.streaming.runs import stream_segment_runs


def line(kind, run_id, mode, at):
    named = "" if run_id is None else f" id:{run_id}"
    return f"<{kind.upper()} ANALYSIS{named}{'' if mode is None else f' mode:{mode}'} timestamp:20240101_{at // 60:02d}{at % 60:02d}00>"


def whole_log():
    """One log with other lines between the markers, the runs that ``advance`` finds in it, by line."""
    log, runs, state = [], {}, NOTHING
    for k, (_, _, kind, run_id, mode) in enumerate(r for r in tangled(5, logs=30, ids=3)):
        if k % 3 == 0:
            log.append("{'predicted_category': 'HR'}" if k % 2 else "")
        log.append(line(kind, run_id, mode, k))
        at = len(log)
        state, (parent, closes, status) = R.advance(state, kind, run_id, mode, at)
        if kind == "begin":
            runs[at] = [run_id, mode, parent, "running"]
        if closes is not None:
            runs[closes][3] = status
    return log, {k: tuple(v) for k, v in runs.items()}


def test_one_log_in_many_steps_out_of_order(spark, tmp_path):
    log, expected = whole_log()
    segments = [log[a : a + 37] for a in range(0, len(log), 37)]
    shelf, source = tmp_path / "shelf", tmp_path / "in" / "run"
    shelf.mkdir()
    source.mkdir(parents=True)
    for k, part in enumerate(segments, 1):
        (shelf / f"{k:06d}.log").write_text("\n".join(part) + "\n" * (k % 2))
    other = tmp_path / "in" / "other"
    other.mkdir()
    order = [3, 1, *range(len(segments), 4, -1), 2, 4]
    steps = [order[:2], order[2:-2], order[-2:]]
    late = tmp_path / "late.log"
    late.write_text("<END ANALYSIS id:none timestamp:20340101_000000>")
    for at, step in enumerate([*steps, [], []]):
        for k in step:
            shutil.copy(shelf / f"{k:06d}.log", source / f"{k:06d}.log")
        if not step:
            shutil.copy(late, other / f"{at - len(steps) + 1}.log")
        query = (
            stream_segment_runs(A.stream_log_segments(spark, str(tmp_path / "in")))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(expected)
    assert {r.run_line: (r.id, r.mode, r.parent_line, r.status) for r in rows} == expected
    numbered = A.numbered_lines(A.read_log_segments(spark, str(source))).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in numbered] == list(enumerate(log, 1))


def test_many_segments_take_no_more_micro_batches(spark, monkeypatch, tmp_path):
    """The stream is asked for as many files at a time as eight steps need, a thousand at least."""
    from docsieve.plans.registry import runs

    class Asked(Exception):
        pass

    def stream(spark, path, files, pattern):
        raise Asked(files)

    rows = [(k, k // 2, "view") for k in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("*", "timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(runs.S, "stream_log_segments", stream)
    monkeypatch.setattr(runs, "SEGMENT_LINES", 1)
    asked = []
    for least in (1000, 1):
        monkeypatch.setattr(runs, "SEGMENT_FILES", least)
        try:
            runs.j9_stream_segments(spark, str(tmp_path))
        except Asked as files:
            asked.append(files.args[0])
    assert asked == [1000, 8]


def test_line_files_are_written_by_the_tasks(spark, tmp_path):
    """One file for each log and segment, a line at a time and in order; keys and lines may be null, logs are added."""
    rows = [(k % 7, k // 70, k, f"line {k}" if k % 9 else None) for k in range(30_000)] + [(None, 1, 1, "no log")]
    lines = spark.createDataFrame(rows, "log_id long, segment long, line_no long, line string").repartition(5, "line")
    A.write_line_files(lines.filter("segment % 2 = 0"), f"file://{tmp_path}/new", ["log_id", "segment"], ["line_no"])
    A.write_line_files(lines.filter("segment % 2 = 1"), f"{tmp_path}/new", ["log_id", "segment"], ["line_no"])
    A.write_line_files(lines, f"{tmp_path}/one", ["log_id"], ["line_no"])

    def files(folder, of):
        want = {}
        for row in sorted(rows, key=lambda r: r[2]):
            at = "/".join(f"{name}={'__HIVE_DEFAULT_PARTITION__' if row[i] is None else row[i]}" for i, name in enumerate(of))
            want[at] = want.get(at, "") + (row[3] or "") + "\n"
        found = {str(f.parent.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file()}
        return found, want

    for folder, of in (("new", ("log_id", "segment")), ("one", ("log_id",))):
        found, want = files(tmp_path / folder, of)
        assert found == want  # no other files, so none of the processes that Hadoop starts for each

    read = A.read_run_log(spark, f"{tmp_path}/one/log_id=3").orderBy("line_no").collect()
    assert [r.line for r in read] == [r[3] or "" for r in rows if r[0] == 3]


def test_segments_are_read_once_to_be_numbered(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k % 5, str(k % 5), k // 5, f"a {k}\nb {k}\r\n\n") for k in range(200)]
    schema = "log_id long, log string, segment long, text string"
    segments = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    found = sorted((r.log, r.line_no, r.line) for r in A.numbered_lines(segments).collect())
    assert found == sorted((str(k % 5), 3 * (k // 5) + i + 1, x) for k in range(200) for i, x in enumerate((f"a {k}", f"b {k}", "")))
    assert seen.value == len(rows)
