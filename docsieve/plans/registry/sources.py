"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.operators.errors import document_errors
from docsieve.session import checkpoint_dir
from docsieve.sources import files as S


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def a1_read_documents(spark, d):
    """Conversations written as text files and read back as documents, one turn per line."""
    path = _folder(spark, "documents")
    turns = X.table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    turns.write.text(path)
    documents = S.read_documents(spark, path, "*.TXT;.md")
    line = documents.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    parsed = line.select(F.from_json("line", "conv_id bigint, turn bigint, text string").alias("j"))
    return parsed.select("j.*")


A1 = "SELECT conv_id, turn, text FROM conversations"


def _paths(spark, d):
    """Page addresses as paths of four file types; every ninth is missing."""
    kind = F.when(F.col("page_id") % 4 == 0, ".txt").when(F.col("page_id") % 4 == 1, ".PDF").when(F.col("page_id") % 4 == 2, ".docx").otherwise(".md")
    path = F.when(F.col("page_id") % 9 != 5, F.concat(F.regexp_replace("url", r"[?#].*$", ""), kind))
    return X.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), path.alias("path"), F.lit(3).alias("page_count"))


_PATH = r"""SELECT page_id AS doc_id, CASE WHEN page_id % 9 <> 5 THEN concat(regexp_replace(url, '[?#].*$', ''),
    CASE page_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' ELSE '.md' END) END AS path FROM pages"""


def a2_document_metadata(spark, d):
    """Every second file names its title, author and date itself."""
    own = F.col("doc_id") % 2 == 0
    paths = _paths(spark, d).withColumns({
        "title": F.when(own, F.concat(F.lit("Title "), F.col("doc_id"))), "author": F.when(own, "somebody"),
        "creation_date": F.when(own, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))),
    })
    found = S.document_metadata(paths)
    created = F.date_format("creation_date", "yyyy-MM-dd").alias("creation_date")
    return found.select("doc_id", "path", "file_type", F.col("page_count").cast("bigint").alias("page_count"), "title", "author", created)


A2 = f"""SELECT doc_id, path, kind AS file_type, CASE kind WHEN 'txt' THEN 1::BIGINT WHEN 'pdf' THEN 3 END AS page_count,
    CASE WHEN doc_id % 2 = 0 THEN concat('Title ', doc_id) ELSE list_last(string_split(path, '/')) END AS title,
    CASE WHEN doc_id % 2 = 0 THEN 'somebody' ELSE '' END AS author,
    CASE WHEN doc_id % 2 = 0 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') END AS creation_date FROM (SELECT *, lower(list_last(string_split(path, '.'))) AS kind FROM ({_PATH}))"""


def a3_with_errors(spark, d):
    return document_errors(_paths(spark, d)).select("doc_id", "path", "error")


A3 = f"""SELECT doc_id, path, CASE WHEN path IS NULL THEN 'path is missing'
    WHEN NOT regexp_matches(path, '(?i)\\.(txt|pdf|docx)$') THEN 'unsupported file type' END AS error FROM ({_PATH})"""


def a4_read_lexicon(spark, d):
    """Part types and their names as the JSON object a lexicon file holds."""
    names = X.table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    entries = F.array_sort(F.collect_list(F.struct("p_type", "names")))
    text = names.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    return S.lexicon_rows(text, "parts").select("kind", "category", "term", "weight", F.col("ord").cast("bigint").alias("ord"))


A4 = """SELECT 'parts' AS kind, p_type AS category, p_name AS term, 1::DOUBLE AS weight,
    (dense_rank() OVER (ORDER BY p_type) - 1) * 100000 + row_number() OVER (PARTITION BY p_type ORDER BY p_name) - 1 AS ord
    FROM (SELECT DISTINCT p_type, p_name FROM part)"""


def a5_assemble_text(spark, d):
    turns = X.table(spark, d, "conversations")
    pages = turns.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page"),
        F.when(F.col("turn") % 3 == 1, " \n").otherwise(F.col("text")).alias("text"),
        F.col("text").alias("ocr_text"),
    )
    return S.assemble_text(pages)


A5 = r"""SELECT conv_id AS doc_id, regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '^\s+', ''), '\s+$', '') AS text
    FROM conversations GROUP BY conv_id"""


def a6_filter_ocr_words(spark, d):
    words = X.spans(spark, d).select(
        "doc_id", "page", F.col("text").alias("word"), (F.col("size") * 2).cast("int").alias("conf"), F.struct("pk", "px").alias("word_no")
    )
    found = S.filter_ocr_words(words)
    return found.select("doc_id", F.col("page").cast("bigint").alias("page"), "ocr_text")


A6 = """SELECT doc_id, CAST(page AS BIGINT) AS page, string_agg(text, ' ' ORDER BY pk, px) AS ocr_text FROM spans
    WHERE CAST(trunc(size * 2) AS INT) >= 60 GROUP BY doc_id, page"""


def a7_prefer_existing(spark, d):
    turns = X.table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("text"))
    kind = F.when(F.col("conv_id") % 2 == 0, "pdf").otherwise("docx")
    documents = turns.select("conv_id", "turn", text.alias("text"), F.col("text").alias("extracted"), kind.alias("file_type"))
    return S.prefer_existing(documents).select("conv_id", "turn", "text", "error")


A7 = """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 AND text <> '' THEN text WHEN conv_id % 2 = 0 THEN text END AS text,
    CASE WHEN NOT (turn % 3 = 1 AND text <> '') AND conv_id % 2 = 1 THEN 'no text extraction for docx' END AS error FROM conversations"""


def a9_read_run_log(spark, d):
    """Log lines written to one file per log and read back; lines are counted by their number."""
    path = _folder(spark, "logs")
    S.write_line_files(X.run_lines(spark, d).select("log_id", "line_no", "line"), path, ["log_id"], ["line_no"])
    return S.read_run_log(spark, f"{path}/*").groupBy("line_no", "line").agg(F.count("*").alias("n"))


def a9_numbered_segments(spark, d):
    """The same lines written as numbered segments of each log, forty lines each, and numbered over the segments."""
    path = _folder(spark, "segments")
    number = F.floor((F.col("line_no") - 1) / 40) + 1
    lines = X.run_lines(spark, d).select("log_id", number.alias("segment"), "line_no", "line")
    S.write_line_files(lines, path, ["log_id", "segment"], ["line_no"])
    segments = S.read_log_segments(spark, path, r"log_id=([^/]+)/segment=0*(\d+)/[^/]*$")
    return S.numbered_lines(segments).select(F.col("log").cast("bigint").alias("log_id"), "line_no", "line")


A9_SEGMENTS = "SELECT log_id, line_no, line FROM run_lines"
A9 = "SELECT line_no, line, count(*) AS n FROM run_lines GROUP BY ALL"

QUERIES = {
    "a1_read_documents": a1_read_documents,
    "a2_document_metadata": a2_document_metadata,
    "a3_with_errors": a3_with_errors,
    "a4_read_lexicon": a4_read_lexicon,
    "a5_assemble_text": a5_assemble_text,
    "a6_filter_ocr_words": a6_filter_ocr_words,
    "a7_prefer_existing": a7_prefer_existing,
    "a9_read_run_log": a9_read_run_log,
    "a9_numbered_segments": a9_numbered_segments,
}
ORACLE = {
    name: X.oracle(sql)
    for name, sql in {
        "a1_read_documents": A1,
        "a2_document_metadata": A2,
        "a3_with_errors": A3,
        "a4_read_lexicon": A4,
        "a5_assemble_text": A5,
        "a6_filter_ocr_words": A6,
        "a7_prefer_existing": A7,
        "a9_read_run_log": A9,
        "a9_numbered_segments": A9_SEGMENTS,
    }.items()
}
