"""Run state kept between micro-batches, and runs given up on timeout."""

from docsieve.streaming.runs import stream_runs
from docsieve.sources.files import stream_run_log

PARTS = [
    [(1, 1, "2024-01-01 00:00:00", "<BEGIN ANALYSIS id:a mode:batch timestamp:20240101_000000>"),
     (2, 1, "2024-01-01 00:00:00", "<BEGIN ANALYSIS id:x mode:analyze timestamp:20240101_000000>")],
    [(1, 2, "2024-01-01 00:01:00", "<BEGIN ANALYSIS id:b mode:analyze timestamp:20240101_000100>")],
    [(1, 3, "2024-01-01 00:02:00", "<END ANALYSIS id:b timestamp:20240101_000200>"),
     (1, 4, "2024-01-01 00:03:00", "<END ANALYSIS id:a timestamp:20240101_000300>")],
    [(3, 1, "2024-03-01 00:00:00", "<END ANALYSIS id:none timestamp:0>")],
    [(3, 2, "2024-03-02 00:00:00", "<END ANALYSIS id:none timestamp:0>")],
]


def test_runs_over_micro_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    query = None
    for part in PARTS:
        spark.createDataFrame(part, "log_id long, line_no long, ts string, line string").coalesce(1).write.mode("append").json(str(source))
        query = (
            stream_runs(stream_run_log(spark, str(source)))
            .writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rows = {r.id: (r.status, r.parent_line, r.duration_seconds) for r in spark.read.parquet(str(out)).collect()}
    assert rows == {"a": ("completed", None, 180), "b": ("completed", 1, 60), "x": ("running", None, None)}


def test_order_counts_over_arrow_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        lines = [(7, n, "2024-01-01 00:00:00", f"<{'END' if n > 20 else 'BEGIN'} ANALYSIS id:{'a' if n in (1, 40) else f'f{min(n, 41 - n)}'} "
                  f"mode:{'batch' if n == 1 else 'analyze'} timestamp:20240101_0000{n:02d}>") for n in (1, 20, 21, 40)]  # fmt: skip
        late = [(8, 1, "2024-03-01 00:00:00", "<END ANALYSIS id:none timestamp:0>")]
        spark.createDataFrame(lines[::-1] + late, "log_id long, line_no long, ts string, line string").coalesce(1).write.json(str(tmp_path / "in"))
        query = (
            stream_runs(stream_run_log(spark, str(tmp_path / "in")))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        rows = {r.id: (r.status, r.parent_line, r.duration_seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert rows == {"a": ("completed", None, 39), "f20": ("completed", 1, 1)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
