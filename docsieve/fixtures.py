"""Test inputs projected from the base tables: Spark builders and the same projections as DuckDB CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import small_table, spread

AS_OF = "2002-01-15"
SPAN_ORDER = ("page", "pk", "px")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def spans(spark: SparkSession, d: str) -> DataFrame:
    step = F.round(F.col("l_discount") * 100).cast("int")
    color = (
        F.when(step == 10, 16777215).when(step == 9, 16448250).when(step == 8, 15790320).when(step == 7, 15856113)
    ).otherwise(step * 1118481)
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    lines = table(spark, d, "lineitem")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.col("p_name").alias("text"),
        F.concat("l_returnflag", "l_linestatus").alias("font"),
        F.col("l_quantity").alias("size"),
        color.alias("color"),
        F.col("l_partkey").alias("pk"),
        F.col("l_extendedprice").alias("px"),
    )


def layout(spans_: DataFrame) -> DataFrame:
    return spans_.select(
        "doc_id", "page", "text", "font", "size",
        F.col("size").alias("x0"), (F.col("page") * 10.0).alias("y0"),
        (F.col("size") + 5.5).alias("x1"), (F.col("page") * 10 + 8.25).alias("y1"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    from docsieve.operators.spans import is_hidden

    kind = F.col("pk") % 5
    label = F.when(kind == 0, "PERSON").when(kind == 1, "ORG").when(kind == 2, "GPE").when(kind == 3, "PRODUCT").otherwise("DATE")
    side = F.when(is_hidden(), "hidden").otherwise("visible")
    return spans(spark, d).select("doc_id", side.alias("side"), label.alias("label"), "text")


def employment(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    current = F.col("o_orderkey") % 37 == 0
    end = F.when(current, F.lit(AS_OF).cast("date")).otherwise(F.add_months(start, (F.col("o_orderkey") % 9).cast("int")))
    records = table(spark, d, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("rec_id"),
        start.alias("start_date"),
        end.alias("end_date"),
        current.alias("is_current"),
    )
    months = (F.year("end_date") - F.year("start_date")) * 12 + F.month("end_date") - F.month("start_date")
    return records.withColumn("duration_months", months)


def resumes(spark: SparkSession, d: str) -> DataFrame:
    rec = F.col("rec_id")
    title = (
        F.when(rec % 5 == 0, "Senior Developer").when(rec % 5 == 1, "Data Scientist").when(rec % 5 == 2, "Head of Sales")
        .when(rec % 5 == 3, "Marketing Manager").otherwise("Analyst")
    )
    employer = F.when(rec % 3 == 0, " at Acme Corp").when(rec % 3 == 1, " with Globex").otherwise(" for Initech Labs")

    def written(pattern: str, now: str):
        end = F.when(F.col("is_current"), now).otherwise(F.date_format("end_date", pattern))
        return F.concat(F.date_format("start_date", pattern), F.lit(" - "), end)

    period = (
        F.when(rec % 101 == 0, "Janvier 1999 - Marzo 2000")
        .when(rec % 13 == 0, written("yyyy", "Current"))
        .otherwise(written("MMM yyyy", "Present"))
    )
    lines = employment(spark, d).select(
        "candidate_id", "rec_id", "start_date", F.concat(title, employer, F.lit(", "), period, F.lit(".")).alias("t")
    )
    history = lines.groupBy("candidate_id").agg(
        F.expr("listagg(t, chr(10)) within group (order by start_date desc, rec_id)").alias("h")
    )
    who = F.col("candidate_id")
    degree = (
        F.when(who % 4 == 0, "Bachelor's degree in Statistics").when(who % 4 == 1, "MBA")
        .when(who % 4 == 2, "MSc and PhD").otherwise("High school")
    )
    skills = F.when(who % 3 == 0, "python, sql and research").when(who % 3 == 1, "sales, excel").otherwise("pottery")
    text = F.concat(
        F.lit("Work Experience\n"), "h", F.lit("\n\nEducation\n"), degree, F.lit("\n\nSkills: "), skills,
        F.lit("\nmail a"), who.cast("string"), F.lit("@example.org or http://example.org/x"),
    )
    return history.select("candidate_id", text.alias("text"))


TRAIN_CUT, LABEL_END = "2000-01-01", "2000-03-01"


def turnover_train(spark: SparkSession, d: str) -> DataFrame:
    from docsieve.operators.employment import turnover_features

    records = employment(spark, d)
    cut = F.lit(TRAIN_CUT).cast("date")
    before = records.filter(F.col("start_date") < cut).withColumn("end_date", F.least("end_date", cut))
    months = (F.year("end_date") - F.year("start_date")) * 12 + F.month("end_date") - F.month("start_date")
    features = turnover_features(before.withColumn("duration_months", months), key="candidate_id", record="rec_id")
    later = records.filter((F.col("start_date") >= cut) & (F.col("start_date") < F.lit(LABEL_END).cast("date")))
    labelled = later.select("candidate_id").distinct().withColumn("label", F.lit(1))
    return features.join(labelled, "candidate_id", "left").fillna(0, ["label"])


PATTERN_LEADS = (
    "bolt bolt bolt bolt is on offer. ",
    "Skills: python, java, sql, excel, word, sales, audit, tax, law, art, music, yoga, ",
    "keywords: hidden phrase for the scanner ",
    "Job title: chief of everything ",
    "one, two; three. four, five; six. seven, eight; nine. ten, ",
    "A plain note without anything special. ",
)


def pattern_docs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, each led by a text that shows one pattern or none."""
    kind = F.col("doc_id") % 6
    lead = F.coalesce(*[F.when(kind == i, t) for i, t in enumerate(PATTERN_LEADS)])
    return documents(spark, d).select("doc_id", F.concat(lead, "text").alias("text"))


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    from docsieve.operators.ordered import along

    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("log_id"), "event_type")
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    order = [F.col("ts"), F.col("event_id")]
    begun = F.when(F.col("event_type") == "signup", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    known = along(e, ["log_id"], order, day, {"line_no": F.lit(1).cast("bigint")}, {"open_id": begun})
    n = F.col("event_id")
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    line = (
        F.when(n % 40 == 7, F.concat(F.lit("{broken "), n.cast("string")))
        .when(
            F.col("event_type") == "signup",
            F.concat(
                F.lit("<BEGIN ANALYSIS id:r"), n.cast("string"), F.lit(" mode:"), F.when(n % 3 == 0, "batch").otherwise("analyze"),
                F.lit(" file:/in/"), (n % 50).cast("string"), F.lit(".pdf timestamp:"), stamp, F.lit(">"),
            ),
        )
        .when((F.col("event_type") == "error") & (n % 13 == 5), F.concat(F.lit("<END ANALYSIS timestamp:"), stamp, F.lit(">")))
        .when(
            F.col("event_type") == "error",
            F.concat(F.lit("<END ANALYSIS id:"), F.coalesce("open_id", F.lit("none")), F.lit(" timestamp:"), stamp, F.lit(">")),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit("{'predicted_category': 'C"), (n % 7).cast("string"), F.lit("', 'confidence': 0.5}")))
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit("{'prediction': {'will_leave': "), F.when(n % 2 == 0, "True").otherwise("False"), F.lit("}}")),
        )
        .otherwise(
            F.concat(
                F.lit("{'white_text_analysis': {'has_white_text': "), F.when(n % 5 == 0, "True").otherwise("False"),
                F.lit(", 'keyword_stuffing_detected': "), F.when(n % 10 == 0, "True").otherwise("False"), F.lit("}}"),
            )
        )
    )
    return known.select("log_id", "line_no", "ts", line.alias("line"))


# --- lexicons (small, our own) --------------------------------------------------------------------------------------

LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "that"),
    "de": ("der", "und", "die", "von"),
    "fr": ("le", "les", "et", "pour"),
    "es": ("el", "que", "los", "y"),
}
LANGUAGE_FALLBACK = {"en": ("with", "which", "thing"), "de": ("nicht", "eine"), "fr": ("une", "dans"), "es": ("una", "por")}
PRODUCT_TERMS = {
    ("industry", "colour"): ("red", "blue", "green"),
    ("industry", "part"): ("bolt", "ring", "widget", "red bolt", "small ring"),
    ("skill", "size"): ("small", "large", "large widget", "blue ring small"),
}
SKILLS = ("python", "sql", "research", "sales", "excel", "c++", "project management")
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "a", "that", "with", "by",
    "der", "die", "und", "von", "le", "la", "les", "et", "el", "los",
)
LEMMAS = {
    "ores": "ore", "hens": "hen", "thes": "the", "ands": "and", "ares": "are",
    "ithe": "the", "tions": "tion", "lesen": "les", "unds": "und", "elle": "el",
}
JOB_TERMS = {
    "Development": ("developer", "software", "python"),
    "Science": ("data scientist", "analyst", "research", "statistics"),
    "Sales": ("sales", "marketing", "head of"),
}
JOB_FALLBACK = {"Development": ("code",), "Science": ("study",), "Sales": ("client",)}
LEXICON_SCHEMA = "kind string, category string, term string, weight double, ord int"


def language_rows() -> list[tuple]:
    rows = [("language", lang, w) for lang, ws in LANGUAGE_WORDS.items() for w in ws]
    return [(k, c, t, 1.0 - 0.1 * (i % 4), i) for i, (k, c, t) in enumerate(rows)]


def product_rows() -> list[tuple]:
    rows = [(k, c, t) for (k, c), ts in PRODUCT_TERMS.items() for t in ts]
    return [(k, c, t, 1.0, i) for i, (k, c, t) in enumerate(rows)]


def job_rows() -> list[tuple]:
    rows = [("job", c, t) for c, ts in JOB_TERMS.items() for t in ts]
    return [(k, c, t, 1.0 - 0.05 * i, i) for i, (k, c, t) in enumerate(rows)]


def job_lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, job_rows(), LEXICON_SCHEMA)


def language_lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, language_rows(), LEXICON_SCHEMA)


def product_lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, product_rows(), LEXICON_SCHEMA)


# --- the same as CTEs -----------------------------------------------------------------------------------------------


def sql_values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def hidden_sql(color: str = "color") -> str:
    return f"(({color} >> 16) & 255) > 240 AND (({color} >> 8) & 255) > 240 AND ({color} & 255) > 240"


_DISC = "CAST(round(l_discount * 100) AS INT)"
_MONTHS = "(year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date)"

CTES = {
    "spans": f"""SELECT l_orderkey AS doc_id, l_linenumber AS page, p_name AS text,
        concat(l_returnflag, l_linestatus) AS font, l_quantity AS size,
        CASE {_DISC} WHEN 10 THEN 16777215 WHEN 9 THEN 16448250 WHEN 8 THEN 15790320 WHEN 7 THEN 15856113
             ELSE {_DISC} * 1118481 END AS color,
        l_partkey AS pk, l_extendedprice AS px FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sided": f"SELECT *, CASE WHEN {hidden_sql()} THEN 'hidden' ELSE 'visible' END AS side FROM spans",
    "entities": """SELECT doc_id, side, CASE pk % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE'
        WHEN 3 THEN 'PRODUCT' ELSE 'DATE' END AS label, text FROM sided""",
    "employment": f"""SELECT *, {_MONTHS} AS duration_months FROM (
        SELECT o_custkey AS candidate_id, o_orderkey AS rec_id, CAST(o_orderdate AS DATE) AS start_date,
        CASE WHEN o_orderkey % 37 = 0 THEN DATE '{AS_OF}'
             ELSE CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 9 AS INT)) AS DATE) END AS end_date,
        o_orderkey % 37 = 0 AS is_current FROM orders)""",
    "resume_lines": """SELECT candidate_id, rec_id, start_date, concat(
        CASE rec_id % 5 WHEN 0 THEN 'Senior Developer' WHEN 1 THEN 'Data Scientist' WHEN 2 THEN 'Head of Sales'
             WHEN 3 THEN 'Marketing Manager' ELSE 'Analyst' END,
        CASE rec_id % 3 WHEN 0 THEN ' at Acme Corp' WHEN 1 THEN ' with Globex' ELSE ' for Initech Labs' END, ', ',
        CASE WHEN rec_id % 101 = 0 THEN 'Janvier 1999 - Marzo 2000'
             WHEN rec_id % 13 = 0 THEN concat(strftime(start_date, '%Y'), ' - ',
                  CASE WHEN is_current THEN 'Current' ELSE strftime(end_date, '%Y') END)
             ELSE concat(strftime(start_date, '%b %Y'), ' - ',
                  CASE WHEN is_current THEN 'Present' ELSE strftime(end_date, '%b %Y') END) END, '.') AS t
        FROM employment""",
    "resumes": """SELECT candidate_id, concat('Work Experience', chr(10),
        string_agg(t, chr(10) ORDER BY start_date DESC, rec_id), chr(10), chr(10), 'Education', chr(10),
        CASE candidate_id % 4 WHEN 0 THEN 'Bachelor''s degree in Statistics' WHEN 1 THEN 'MBA' WHEN 2 THEN 'MSc and PhD'
             ELSE 'High school' END, chr(10), chr(10), 'Skills: ',
        CASE candidate_id % 3 WHEN 0 THEN 'python, sql and research' WHEN 1 THEN 'sales, excel' ELSE 'pottery' END,
        chr(10), 'mail a', candidate_id, '@example.org or http://example.org/x') AS text
        FROM resume_lines GROUP BY candidate_id""",
    "pattern_docs": "SELECT doc_id, concat(CASE doc_id % 6 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PATTERN_LEADS))
    + " END, text) AS text FROM documents",
    "numbered_events": """SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line_no,
        last_value(CASE WHEN event_type = 'signup' THEN concat('r', event_id) END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS open_id FROM events""",
    "run_lines": """SELECT user_id AS log_id, line_no, ts, CASE
        WHEN event_id % 40 = 7 THEN concat('{broken ', event_id)
        WHEN event_type = 'signup' THEN concat('<BEGIN ANALYSIS id:r', event_id, ' mode:',
             CASE WHEN event_id % 3 = 0 THEN 'batch' ELSE 'analyze' END, ' file:/in/', event_id % 50, '.pdf timestamp:',
             strftime(ts, '%Y%m%d_%H%M%S'), '>')
        WHEN event_type = 'error' AND event_id % 13 = 5 THEN concat('<END ANALYSIS timestamp:', strftime(ts, '%Y%m%d_%H%M%S'), '>')
        WHEN event_type = 'error' THEN concat('<END ANALYSIS id:', coalesce(open_id, 'none'), ' timestamp:',
             strftime(ts, '%Y%m%d_%H%M%S'), '>')
        WHEN event_type = 'view' THEN concat('{''predicted_category'': ''C', event_id % 7, ''', ''confidence'': 0.5}')
        WHEN event_type = 'click' THEN concat('{''prediction'': {''will_leave'': ',
             CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END, '}}')
        ELSE concat('{''white_text_analysis'': {''has_white_text'': ', CASE WHEN event_id % 5 = 0 THEN 'True' ELSE 'False' END,
             ', ''keyword_stuffing_detected'': ', CASE WHEN event_id % 10 = 0 THEN 'True' ELSE 'False' END, '}}') END AS line
        FROM numbered_events""",
    "language_lexicon": sql_values(language_rows(), "kind, category, term, weight, ord"),
    "job_lexicon": sql_values(job_rows(), "kind, category, term, weight, ord"),
    "resume_docs": "SELECT candidate_id AS doc_id, text FROM resumes",
    "product_lexicon": sql_values(product_rows(), "kind, category, term, weight, ord"),
}


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with every CTE it needs, found by name, in front of it."""
    known = {**CTES, **(extra or {})}
    ordered: dict[str, str] = {}

    def need(text: str) -> None:
        for name, body in known.items():
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s*(?:WHERE|GROUP|$))", text, re.I):
                need(body)
                ordered[name] = f"{name} AS ({body})"

    need(sql)
    recursive = "RECURSIVE " if any("UNION ALL" in b and re.search(rf"FROM {n}\b", b) for n, b in known.items() if n in ordered) else ""
    if not ordered:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    head = f"WITH {'RECURSIVE ' if recursive or (own and own.group(1)) else ''}" + ",\n".join(ordered.values())
    return head + (",\n" + sql[own.end() :] if own else "\n" + sql)
