"""Documents, lexicons, page texts and logs as tables; results as JSON and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.functions.text import strip
from docsieve.operators.errors import SUPPORTED, extension
from docsieve.operators.ordered import place, position


def read_documents(spark: SparkSession, path: str, types: Sequence[str] | str | None = None) -> DataFrame:
    """``path, text`` of the files of one folder with the given extensions; others are left out.

    ``types`` is a list or ``".txt;.md"``. Folders below are not entered.
    """
    wanted = types.split(";") if isinstance(types, str) else list(types or SUPPORTED)
    wanted = sorted({"." + w.strip().lstrip("*.").lower() for w in wanted if w.strip()})
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.filter(extension("path").isin(wanted))


def document_metadata(documents: DataFrame) -> DataFrame:
    """``path, file_type, page_count, title, author, creation_date``: a text file is one page, a .docx has no page count.

    What the input knows (``title, author, creation_date``, as the reader of a PDF finds them) stays; otherwise the title is
    the file's name, the author empty and the date NULL.
    """
    kind = F.regexp_replace(extension("path"), r"^\.", "")
    pages = F.when(kind == "txt", F.lit(1))
    if "page_count" in documents.columns:
        pages = F.coalesce(pages, F.when(kind == "pdf", F.col("page_count")))
    others = [c for c in documents.columns if c not in ("path", "page_count", "title", "author", "creation_date")]

    def known(column: str, otherwise: Column) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), otherwise) if column in documents.columns else otherwise

    created = F.col("creation_date") if "creation_date" in documents.columns else F.lit(None)
    return documents.select(
        *others,
        "path",
        kind.alias("file_type"),
        pages.alias("page_count"),
        known("title", F.element_at(F.split("path", "/"), -1)).alias("title"),
        known("author", F.lit("")).alias("author"),
        created.cast("timestamp").alias("creation_date"),
    )


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON object of category to terms as ``kind, category, term, weight, ord``."""
    text = spark.read.text(path, wholetext=True).select("value")
    return lexicon_rows(text, kind)


def lexicon_rows(text: DataFrame, kind: str, column: str = "value") -> DataFrame:
    parsed = text.select(F.from_json(column, "map<string,array<string>>").alias("m"))
    entries = F.map_entries("m")
    categories = parsed.select(F.posexplode(entries).alias("c_no", "e"))
    terms = categories.select("c_no", F.col("e.key").alias("category"), F.posexplode("e.value").alias("t_no", "term"))
    return terms.select(
        F.lit(kind).alias("kind"),
        "category",
        "term",
        F.lit(1.0).alias("weight"),
        (F.col("c_no") * 100_000 + F.col("t_no")).cast("int").alias("ord"),
    )


def assemble_text(pages: DataFrame, ocr: bool = True) -> DataFrame:
    """``doc_id, text``: pages in order, separated by a blank line; blank pages are replaced by their OCR text."""
    text = F.col("text")
    if ocr:
        text = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.coalesce("ocr_text", F.lit(""))).otherwise(F.col("text"))
    joined = F.expr(r"listagg(t, '\n\n') within group (order by page)")
    return (
        pages.select("doc_id", "page", F.coalesce(text, F.lit("")).alias("t"))
        .groupBy("doc_id")
        .agg(joined.alias("text"))
        .select("doc_id", strip("text").alias("text"))
    )


def filter_ocr_words(words: DataFrame, min_conf: int = 60) -> DataFrame:
    """``doc_id, page, ocr_text``: confident, non-blank words in order."""
    kept = words.filter((F.col("conf") >= min_conf) & (strip("word") != ""))
    return kept.groupBy("doc_id", "page").agg(F.expr("listagg(word, ' ') within group (order by word_no)").alias("ocr_text"))


def prefer_existing(documents: DataFrame) -> DataFrame:
    """Existing text wins over extracted text, which exists for PDF only; ``error`` where neither applies."""
    existing = F.nullif(F.col("text"), F.lit(""))
    extractable = F.col("file_type") == "pdf"
    others = [c for c in documents.columns if c not in ("text", "extracted")]
    return documents.select(
        *others,
        F.coalesce(existing, F.when(extractable, F.col("extracted"))).alias("text"),
        F.when(existing.isNull() & ~extractable, F.concat(F.lit("no text extraction for "), "file_type")).alias("error"),
    )


def write_line_files(lines: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> None:
    """``line`` of each row, by ``order``, in one file for every value of the whole numbers ``by``, in the folders that
    ``partitionBy`` makes (``<path>/a=1/b=2/<file>``). Files are added to what is there.

    On a local or mounted disk Hadoop starts a ``chmod`` for every file and folder, which takes far longer than the lines;
    there the tasks write the files themselves, a line at a time, so a file may be of any length. A task that is run again
    replaces its files. Other stores are written by Spark.
    """
    placed = lines.repartition(*by).sortWithinPartitions(*by, *order)
    folder = _disk_folder(lines.sparkSession, path)
    if folder is None:
        placed.select(*by, "line").write.mode("append").partitionBy(*by).text(path)
        return
    names = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in by]
    # As in Spark's text files, a null line is an empty one.
    rows = placed.select(F.concat_ws("/", *names).alias("at"), F.coalesce(F.col("line").cast("binary"), F.lit(b"")).alias("line"))

    def write(batches):
        import os
        import uuid

        at, file, written = None, None, 0
        mine = f".part-{uuid.uuid4().hex}"  # readers pass over such names

        def close():
            file.close()
            os.replace(f"{folder}/{at}/{mine}", f"{folder}/{at}/part-0.txt")

        for batch in batches:
            for to, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if to != at:
                    if file is not None:
                        close()
                    at, written = to, written + 1
                    os.makedirs(f"{folder}/{at}", exist_ok=True)
                    file = open(f"{folder}/{at}/{mine}", "wb")  # noqa: SIM115
                file.write(line + b"\n")
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _disk_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` is on a local or mounted disk, or None if another store holds it."""
    context = spark.sparkContext
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    store = named.getFileSystem(context._jsc.hadoopConfiguration())
    return store.makeQualified(named).toUri().getPath() if store.getUri().getScheme() == "file" else None


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``log_id, line_no, line`` of the log files under ``path``, numbered within each file as they stand there.

    Large files are read in blocks by many tasks; a line's number is its place in the block plus the lines of the
    blocks before it.
    """
    lines = spark.read.text(path).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("log_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )
    numbered = position(lines, ["log_id"], [F.col("place")], F.col("block"), "line_no")
    return numbered.select("log_id", "line_no", "line")


RUN_LINE_SCHEMA = "log_id bigint, line_no bigint, ts timestamp, line string"


def stream_run_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The appended log as a stream of ``log_id, line_no, ts, line``."""
    return spark.readStream.schema(RUN_LINE_SCHEMA).format(fmt).load(path)


#: ``<log>/<number>.<ending>``: a log is a folder, its files are segments numbered from 1.
SEGMENT_FILE = r"([^/]+)/0*(\d+)\.[^/]*$"


def _segments(files: DataFrame, pattern: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(F.regexp_replace(path, pattern, "$1")).alias("log_id"),
        F.regexp_extract(path, pattern, 1).alias("log"),
        F.regexp_extract(path, pattern, 2).try_cast("bigint").alias("segment"),
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("value").alias("text"),
    ).filter("segment is not null")


def read_log_segments(spark: SparkSession, path: str, pattern: str = SEGMENT_FILE) -> DataFrame:
    """``log_id, log, segment, written, text`` of the segment files under ``path``, one row a file.

    ``pattern`` finds a log's name and a segment's number in a path; other files are passed over."""
    return _segments(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True), pattern)


def stream_log_segments(spark: SparkSession, path: str, files: int | None = None, pattern: str = SEGMENT_FILE) -> DataFrame:
    """The same as a stream: a segment is taken up once it is there, ``files`` at most in a micro-batch.

    A log is written by adding files: what is appended between two files is one segment, so a segment is as large as its
    writer makes it and a log may be of any length.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    return _segments((reader if files is None else reader.option("maxFilesPerTrigger", files)).text(path, wholetext=True), pattern)


def numbered_lines(segments: DataFrame) -> DataFrame:
    """``log_id, log, line_no, line`` of segments in a table: a line's place plus the lines of the segments before it.

    The segments are read once and sent once; only their counts are summed over a log and joined to them."""
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), "\r?\n")
    cut = segments.filter("text <> ''").select("log_id", "log", "segment", lines.alias("lines"))
    placed = place(cut, ["log_id"], F.col("segment"))
    before = Window.partitionBy("log_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.select("log_id", "segment", F.size("lines").cast("bigint").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    known = placed.join(counts.drop("n"), ["log_id", "segment"])
    places = known.select("log_id", "log", "earlier", F.posexplode("lines").alias("k", "line"))
    return places.select("log_id", "log", (F.col("earlier") + F.col("k") + 1).alias("line_no"), "line")


def _present(flag: Column, value: Column) -> Column:
    return F.when(flag, value)


def detection_struct(results: DataFrame) -> DataFrame:
    """``doc_id, json``: the detection report of each document; what was found is only there if something was."""
    has = F.coalesce("has_hidden", F.lit(False))
    columns = set(results.columns)
    found = [
        _present(has, F.col(c)).alias(name)
        for c, name in (("hidden_text", "white_text_content"), ("common_words", "common_words"), ("hits", "potential_keywords"))
        if c in columns
    ]
    body = F.struct(
        F.struct(F.col("path").alias("filename"), "file_type", "page_count").alias("document_info"),
        F.struct(
            has.alias("has_white_text"),
            F.col("hidden_count").alias("white_text_count"),
            F.col("hidden_percentage").alias("white_text_percentage"),
            F.coalesce("stuffing", F.lit(False)).alias("keyword_stuffing_detected"),
        ).alias("detection_results"),
        *found,
    )
    return results.select("doc_id", body.alias("report"))


def to_detection_json(results: DataFrame) -> DataFrame:
    return detection_struct(results).select("doc_id", F.to_json("report").alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
