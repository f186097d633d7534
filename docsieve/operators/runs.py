"""Run history: from log lines (``log_id, line_no, line``) to runs, their results and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.text import strip
from docsieve.operators.ordered import around, last_seen
from docsieve.session import cut_lineage

# The log's markers and their time format.
BEGIN, END = "<BEGIN ANALYSIS", "<END ANALYSIS"
TIME_FORMAT = "yyyyMMdd_HHmmss"
MARKER_KEYS = ("id", "mode", "file", "pattern", "timestamp")
LINES_PER_BUCKET = 4096
#: Buckets that a lookup by id takes together: few lines have one id.
LINES_PER_KEY = 256
#: Markers of a log that is folded in one row.
SHORT_LOG = 512
#: After every line.
LAST_LINE = (1 << 63) - 1

# Which key names the kind of a result line, tested in this order.
RESULT_KINDS = (
    ("white_text_analysis", "hidden_text"),
    ("predicted_category", "classification"),
    ("prediction", "turnover"),
    ("skills", "skills"),
    ("author", "metadata"),
)


def _value(body: Column, key: str) -> Column:
    """The last ``key:value`` among the whitespace-separated parts; NULL if there is none."""
    pattern = rf"(?s)^(?:.*\s)?{key}:(\S*)"
    return F.when(body.rlike(pattern), F.regexp_extract(body, pattern, 1))


def to_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def parse_marker(lines: DataFrame) -> DataFrame:
    """``kind`` (begin, end or NULL) and the marker's values; a value with spaces is cut at the first one."""
    line = strip("line")
    kind = F.when(line.startswith(BEGIN), "begin").when(line.startswith(END), "end")
    skip = F.when(F.col("kind") == "begin", len(BEGIN)).otherwise(len(END))
    marked = lines.withColumns({"_l": line, "kind": kind})
    body = F.substring(F.col("_l"), skip + 1, F.length("_l") - skip - 1)
    marked = marked.withColumn("_b", F.when(F.col("kind").isNotNull(), body))
    return marked.withColumns({k: _value(F.col("_b"), k) for k in MARKER_KEYS}).drop("_l", "_b")


def marker_struct(line: Column, place: Column) -> Column:
    """What ``parse_marker`` says of one line of an array, with its place ``k`` from 1 and its ``time``."""
    text = strip(line)
    kind = F.when(text.startswith(BEGIN), "begin").when(text.startswith(END), "end")
    skip = F.when(kind == "begin", len(BEGIN)).otherwise(len(END))
    body = F.when(kind.isNotNull(), F.substring(text, skip + 1, F.length(text) - skip - 1))
    values = {k: _value(body, k) for k in ("id", "mode", "timestamp")}
    return F.struct((place + 1).alias("k"), kind.alias("kind"), *[v.alias(k) for k, v in values.items()], to_time(values["timestamp"]).alias("time"))


# Fixed value: the quotes that become double quotes.
LITERAL_QUOTE = r"(?<![a-zA-Z])'|'(?![a-zA-Z])"


def repair_literal(line: Column | str) -> Column:
    """A Python literal as JSON text: quotes next to a non-letter become double quotes, constants JSON's."""
    line = F.col(line) if isinstance(line, str) else line
    text = F.regexp_replace(strip(line), LITERAL_QUOTE, '"')
    for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.replace(text, F.lit(word), F.lit(json_word))
    return text


def parse_result(lines: DataFrame) -> DataFrame:
    """The lines that hold a result, with ``result`` as JSON text; anything that cannot be read is left out."""
    other = ~strip("line").startswith("<BEGIN ANALYSIS") & ~strip("line").startswith("<END ANALYSIS")
    parsed = lines.filter(other).withColumn("result", repair_literal("line"))
    return parsed.filter(F.try_parse_json("result").isNotNull() & F.json_object_keys("result").isNotNull())


def result_kind(result: Column | str = "result") -> Column:
    keys = F.json_object_keys(result)
    kind = F.lit(None).cast("string")
    for key, name in reversed(RESULT_KINDS):
        kind = F.when(F.array_contains(keys, key), name).otherwise(kind)
    return kind


def route_result(results: DataFrame) -> DataFrame:
    return results.withColumn("result_kind", result_kind())


# --- which run is open ----------------------------------------------------------------------------------------------


def advance(state: tuple, kind: str, run_id: str | None, mode: str | None, line_no: int) -> tuple[tuple, tuple]:
    """One marker. State: (line, id) of the open run and of the open file in it, ``(None, None)`` for none.

    Returns the new state and what happened: (line of the parent, line of the run that closed, its status).
    """
    (top, top_id), (child, child_id) = state
    nothing = (None, None)
    if kind == "begin":
        if mode == "analyze" and top is not None:
            return ((top, top_id), (line_no, run_id)), (top, None, None)
        return ((line_no, run_id), nothing), (None, None, None)
    if run_id is None:
        if child is not None:
            return ((top, top_id), nothing), (None, child, "error")
        return (nothing, nothing), (None, top, "error" if top is not None else None)
    if child is not None and run_id == child_id:
        return ((top, top_id), nothing), (None, child, "completed")
    if top is not None and run_id == top_id:
        return (nothing, nothing), (None, top, "completed")
    return state, (None, None, None)


def _bucket(lines: int = LINES_PER_BUCKET) -> Column:
    return F.floor(F.col("line_no") / lines)


def _closings(markers: DataFrame) -> DataFrame:
    """What each marker can tell without knowing which runs are open.

    Between a begin and the next one its run is the open file, if it isn't the open run itself. The first end there that
    names it or can't be read concerns it (``is_own``); every other end is free. So a begin, taken as the open run, closes
    at its own end, or at the first free end after it that names it or can't be read (``close``: the line, and the first
    begin after that), unless a batch begins before (``gives_way``). ``next_top``: the begin that is the open run after it.
    """
    line, order = F.col("line_no"), ["line_no"]
    begin, end = F.col("kind") == "begin", F.col("kind") == "end"
    unread = end & F.col("id").isNull()
    batch = begin & ~F.col("mode").eqNullSafe("analyze")
    far = _bucket(LINES_PER_BUCKET * LINES_PER_KEY)
    named = F.col("id").isNotNull()

    m = around(markers, ["log_id", "id"], order, far, {"_end_before": F.when(end, line)}, {"_own_end": F.when(end, line)})
    m = m.withColumn("_own_end", F.when(named, F.col("_own_end")))
    m = around(
        m, ["log_id"], order, _bucket(),
        {"last_begin": F.when(begin, F.struct("line_no", "id", "_own_end")), "_unread_before": F.when(unread, line)},
        {"_next_begin": F.when(begin, line), "_next_batch": F.when(batch, line), "_next_unread": F.when(unread, line)},
    )
    since = F.col("last_begin.line_no")
    none_unread = F.coalesce(F.col("_unread_before") < since, F.lit(True))
    names = F.coalesce(F.col("id") == F.col("last_begin.id"), F.lit(False))
    first_named = names & F.coalesce(F.col("_end_before") < since, F.lit(True))
    not_ended = F.coalesce(F.col("last_begin._own_end") > line, F.lit(True))
    own = end & since.isNotNull() & none_unread & F.when(unread, not_ended).otherwise(first_named)
    over = ~none_unread | unread | F.coalesce(F.col("last_begin._own_end") <= line, F.lit(False))
    m = m.withColumns({"is_own": own, "own_over": over})
    free = end & ~F.col("is_own")
    reached = F.struct("line_no", "_next_begin")
    m = around(m, ["log_id"], order, _bucket(), after={"_free_unread": F.when(free & unread, reached)})
    m = around(m, ["log_id", "id"], order, far, after={"_free_named": F.when(free & named, reached)})
    first = F.least("_own_end", "_next_unread")
    mine = F.when(F.coalesce(first < F.col("_next_begin"), first.isNotNull()), F.struct(first.alias("line_no"), "_next_begin"))
    close = F.when(begin, F.least(mine, F.col("_free_unread"), F.when(named, F.col("_free_named"))))
    m = m.withColumn("close", close)
    closed = F.coalesce(F.col("close.line_no") < F.col("_next_batch"), F.col("close").isNotNull())
    return m.withColumns({
        "batch": batch,
        "gives_way": F.when(begin, F.least("close.line_no", "_next_batch")),
        "next_top": F.when(begin, F.when(closed, F.col("close._next_begin")).otherwise(F.col("_next_batch"))),
    }).select(*markers.columns, "last_begin.line_no", "is_own", "own_over", "batch", "close.line_no", "gives_way", "next_top").toDF(
        *markers.columns, "begin_line", "is_own", "own_over", "batch", "close_line", "gives_way", "next_top"
    )


def _open_runs(begins: DataFrame, heads: DataFrame) -> DataFrame:
    """The begins (log_id, line_no) that are the open run: ``heads`` and what follows them by ``next_top``.

    What lies between heads is found by pointer jumping: each round doubles the distance that pointers span, so a chain of
    n runs takes log n rounds, and no task follows a chain.
    """
    known = heads.select("log_id", "line_no")
    to = lambda df: df.select("log_id", F.col("next_top").alias("line_no")).filter("line_no is not null").distinct()
    fresh = cut_lineage(to(begins.join(known, ["log_id", "line_no"], "left_semi")).join(known, ["log_id", "line_no"], "left_anti"))
    if fresh.isEmpty():
        return known
    other = begins.select("log_id", "line_no", "next_top").join(known, ["log_id", "line_no"], "left_anti")
    inner = known.select("log_id", F.col("line_no").alias("next_top"))
    jumps = cut_lineage(other.filter("next_top is not null").join(inner, ["log_id", "next_top"], "left_anti").select("log_id", "line_no", "next_top"))
    while True:
        reached = fresh.join(jumps, ["log_id", "line_no"]).select("log_id", F.col("next_top").alias("line_no"))
        wider = cut_lineage(fresh.union(reached).distinct())
        if wider.count() == fresh.count():
            return known.union(fresh)
        fresh = wider
        on = jumps.select("log_id", F.col("line_no").alias("next_top"), F.col("next_top").alias("_far"))
        jumps = cut_lineage(jumps.join(on, ["log_id", "next_top"]).select("log_id", "line_no", F.col("_far").alias("next_top")))


def _looked_up(markers: DataFrame, settled: bool = True) -> DataFrame:
    """For logs of any length: ends are matched by ordered lookups over ranges of lines. A begin is known to be the open run
    where a batch begins, and where every earlier run of the log has closed (``settled``; without it only the first begin
    of a log is); the few others are found by pointer jumping. No task follows a log."""
    m = _closings(markers)
    begin, line = F.col("kind") == "begin", F.col("line_no")
    m = cut_lineage(around(m, ["log_id"], ["line_no"], _bucket(), highest={"_latest": F.when(begin, F.coalesce("gives_way", F.lit(LAST_LINE)))}))
    begins = m.filter(begin)
    early = F.col("_latest").isNull()
    heads = begins.filter(F.col("batch") | early | (F.col("_latest") < line if settled else F.lit(False)))
    tops = _open_runs(begins, heads).withColumn("is_top", F.lit(True))
    m = m.join(tops, ["log_id", "line_no"], "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))
    m = around(m, ["log_id"], ["line_no"], _bucket(), {"top": F.when(F.col("is_top"), F.struct("line_no", "close_line"))})

    end, unread = F.col("kind") == "end", F.col("id").isNull()
    top, begun = F.col("top.line_no"), F.col("begin_line")
    was_open = F.coalesce(F.col("top.close_line") >= line, top.isNotNull())
    stays_open = F.coalesce(F.col("top.close_line") > line, top.isNotNull())
    closes_file = end & was_open & (begun != top) & F.col("is_own")
    closes = F.when(closes_file, begun).when(end & (F.col("top.close_line") == line), top)
    top_after = F.when(F.col("is_top"), line).when(stays_open, top)
    file_after = F.when(F.col("is_top"), line).when(begin, line).when(stays_open, F.when((begun != top) & ~F.col("own_over"), begun).otherwise(top))
    return m.select(
        "log_id", "line_no", "kind", *MARKER_KEYS,
        F.when(begin & ~F.col("is_top"), top).alias("parent_line"),
        closes.alias("closes_line"),
        F.when(closes.isNotNull(), F.when(unread, "error").otherwise("completed")).alias("closes_status"),
        top_after.alias("top_line"),
        file_after.alias("open_line"),
    )


def _folded(markers: DataFrame) -> DataFrame:
    """For short logs: each log's markers in order, folded into what ``advance`` says of them, in the row expression."""
    x_type = "struct<line_no:bigint,kind:string,id:string,mode:string,file:string,pattern:string,timestamp:string>"
    run, said = "struct<line_no:bigint,id:string>", "struct<parent_line:bigint,closes_line:bigint,closes_status:string,top_line:bigint,open_line:bigint>"
    nobody = F.lit(None).cast(run)

    def step(state: Column, x: Column) -> Column:
        top, child = state["top"], state["child"]
        begin, unread = x["kind"] == "begin", x["id"].isNull()
        inside = begin & x["mode"].eqNullSafe("analyze") & top.isNotNull()
        ends_child = ~begin & child.isNotNull() & F.coalesce(unread | (x["id"] == child["id"]), F.lit(False))
        ends_top = ~begin & ~ends_child & top.isNotNull() & F.coalesce(unread | (x["id"] == top["id"]), F.lit(False))
        this = F.struct(x["line_no"].alias("line_no"), x["id"].alias("id")).cast(run)
        new_top = F.when(begin & ~inside, this).when(ends_top, nobody).otherwise(top)
        new_child = F.when(inside, this).when(begin | ends_child | ends_top, nobody).otherwise(child)
        closes = F.when(ends_child, child["line_no"]).when(ends_top, top["line_no"])
        told = F.struct(
            F.when(inside, top["line_no"]).alias("parent_line"),
            closes.alias("closes_line"),
            F.when(closes.isNotNull(), F.when(unread, "error").otherwise("completed")).alias("closes_status"),
            new_top["line_no"].alias("top_line"),
            F.coalesce(new_child["line_no"], new_top["line_no"]).alias("open_line"),
        ).cast(said)
        return F.struct(new_top.alias("top"), new_child.alias("child"), F.array_append(state["told"], told).alias("told"))

    start = F.struct(nobody.alias("top"), nobody.alias("child"), F.array().cast(f"array<{said}>").alias("told"))
    in_order = F.sort_array(F.collect_list(F.struct("line_no", "kind", *MARKER_KEYS).cast(x_type)))
    logs = markers.groupBy("log_id").agg(in_order.alias("m"))
    both = logs.select("log_id", F.explode(F.arrays_zip("m", F.aggregate("m", start, step, lambda state: state["told"]).alias("told"))).alias("r"))
    return both.select("log_id", "r.m.*", "r.told.*")


def assign_markers(lines: DataFrame, settled: bool = True) -> DataFrame:
    """Every marker with the run it begins or ends, and the run open after it, as ``advance`` would say line by line.

    Logs of up to ``SHORT_LOG`` markers are folded each in its row; longer ones are cut into ranges of lines that work on
    their own. Both give the same.
    """
    markers = cut_lineage(parse_marker(lines).filter("kind is not null").select("log_id", "line_no", "kind", *MARKER_KEYS))
    long = markers.groupBy("log_id").count().filter(F.col("count") > SHORT_LOG).select("log_id")
    if long.isEmpty():
        return _folded(markers)
    long = cut_lineage(long)
    rest = _folded(markers.join(long, "log_id", "left_anti"))
    return rest.unionByName(_looked_up(markers.join(long, "log_id", "left_semi"), settled))


def assign_to_run(lines: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Result lines with ``run_line``: the begin line of the run open at that point, NULL if none is."""
    markers = assign_markers(lines) if markers is None else markers
    results = route_result(parse_result(lines)).select(
        "log_id", "line_no", "result", "result_kind", F.lit(None).cast("struct<open_line:bigint>").alias("state")
    )
    states = markers.select(
        "log_id",
        "line_no",
        F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("string").alias("result_kind"),
        F.struct("open_line").alias("state"),
    )
    both = last_seen(
        results.unionByName(states), ["log_id"], [F.col("line_no")], _bucket(), F.col("state"), "open_state"
    )
    return both.filter("result is not null").select(
        "log_id", "line_no", "result", "result_kind", F.col("open_state.open_line").alias("run_line")
    )


def run_status(markers: DataFrame) -> DataFrame:
    """One row per run: where it begins, its parent, status, times and duration in seconds.

    A marker concerns one run, the one it begins or the one it closes; both meet in one aggregation.
    """
    begins = F.col("kind") == "begin"
    closes = F.col("closes_line").isNotNull()
    about = markers.filter(begins | closes).withColumn("run_line", F.coalesce("closes_line", "line_no"))

    def own(column: str) -> Column:
        return F.max(F.when(begins, F.col(column)))

    runs = about.groupBy("log_id", "run_line").agg(
        *[own(c).alias(c) for c in ("id", "mode", "file", "pattern")],
        own("timestamp").alias("start_time"),
        own("parent_line").alias("parent_line"),
        F.max("closes_status").alias("end_status"),
        F.max(F.when(closes, F.col("timestamp"))).alias("ended"),
    )
    completed = F.col("end_status") == "completed"
    seconds = F.unix_timestamp(to_time(F.col("ended"))) - F.unix_timestamp(to_time(F.col("start_time")))
    return runs.select(
        "log_id", "run_line", "id", "mode", "file", "pattern", "start_time", "parent_line",
        F.coalesce("end_status", F.lit("running")).alias("status"),
        F.when(completed, F.col("ended")).alias("end_time"),
        F.when(completed, seconds).alias("duration_seconds"),
    )


def latest_runs(runs: DataFrame, n: int = 10, highest: int = 100) -> DataFrame:
    """The newest top-level runs; ``n`` below one means ten."""
    n = 10 if n < 1 else min(n, highest)
    order = [F.desc_nulls_last(to_time(F.col("start_time"))), F.desc("log_id"), F.desc("run_line")]
    return runs.filter("parent_line is null").orderBy(*order).limit(n)


def run_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their last result of each kind as JSON text."""
    named = results.filter("run_line is not null and result_kind is not null")
    last = named.groupBy("log_id", "run_line").agg(
        *[
            F.max_by(F.when(F.col("result_kind") == kind, F.col("result")), F.when(F.col("result_kind") == kind, F.col("line_no"))).alias(kind)
            for _, kind in RESULT_KINDS
        ]
    )
    return runs.join(last, ["log_id", "run_line"], "left")


def run_by_id(runs_with_results: DataFrame, run_id: str) -> DataFrame:
    return runs_with_results.filter(F.col("id") == run_id)


def batch_run_summary(runs_with_results: DataFrame, top: int = 3) -> DataFrame:
    """Per batch run: files by status, detections, top categories and turnover outcomes of its completed files."""
    batches = runs_with_results.filter("mode = 'batch' and parent_line is null").select(
        "log_id", "run_line", "id", "status"
    )
    done = F.col("status") == "completed"
    hidden = F.get_json_object("hidden_text", "$.white_text_analysis")
    leave = F.get_json_object("turnover", "$.prediction.will_leave")
    category = F.get_json_object("classification", "$.predicted_category")
    files = runs_with_results.filter("parent_line is not null").select(
        "log_id", F.col("parent_line").alias("run_line"), "status",
        (done & F.coalesce(F.get_json_object(hidden, "$.has_white_text") == "true", F.lit(False))).alias("hidden"),
        (done & F.coalesce(F.get_json_object(hidden, "$.keyword_stuffing_detected") == "true", F.lit(False))).alias("stuffing"),
        F.when(done, category).alias("category"),
        F.when(done, leave).alias("leave"),
    )
    key = ["log_id", "run_line"]
    counts = files.groupBy(*key).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "completed").alias("completed_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.count_if(F.col("status") == "running").alias("running_files"),
        F.count_if("hidden").alias("hidden_detections"),
        F.count_if("stuffing").alias("stuffing_detections"),
        F.count_if(F.col("leave") == "true").alias("will_leave"),
        F.count_if(F.col("leave") == "false").alias("will_stay"),
    )
    per_category = files.filter("category is not null").groupBy(*key, "category").agg(F.count("*").alias("n"))
    best = Window.partitionBy(*key).orderBy(F.desc("n"), "category")
    ranked = per_category.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    tops = ranked.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "n"))), lambda x: F.concat_ws(":", x["category"], x["n"])),
            ",",
        ).alias("top_categories")
    )
    numbers = [c for c in counts.columns if c not in key]
    return batches.join(counts, key, "left").join(tops, key, "left").fillna(0, numbers)
