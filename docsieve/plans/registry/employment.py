"""Employment history and turnover score."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve import fixtures as X
from docsieve.functions.dates import with_parsed_range
from docsieve.functions.matching import EMPLOYMENT_RANGE, matches
from docsieve.operators import employment as E
from docsieve.operators import turnover as T
from docsieve.plans.registry.texts import COMPANY_SQL, RANGE_RE2, TITLE_SQL, found_sql

KEY, REC = "candidate_id", "rec_id"


def _records(spark, d):
    return X.employment(spark, d)


def _candidates(spark, d):
    """All customers; those without an order have an empty history. Ids that no customer has are added for the same."""
    known = X.table(spark, d, "customer").select(F.col("c_custkey").alias(KEY))
    return known.unionByName(known.select((-F.col(KEY) - 1).alias(KEY)))


CANDIDATES = "SELECT c_custkey AS candidate_id FROM customer UNION ALL SELECT -c_custkey - 1 FROM customer"


def _r(*names, digits=6):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def _b(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _d(*names):
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


def f1_extract_employment(spark, d):
    found = E.extract_employment(X.resumes(spark, d), X.AS_OF)
    return found.select(
        KEY, *_b("rec_no"), "date_range", *_d("start_date", "end_date"), *_b("duration_months"), "is_current", "job_title", "company", "context"
    )


_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _point(text: str) -> str:
    name = f"regexp_extract({text}, '^([a-z]+) ?\\d{{4}}$', 1)"
    year = f"TRY_CAST(regexp_extract({text}, '(\\d{{4}})$', 1) AS INT)"
    month = (
        f"CASE WHEN {name} = '' THEN month(DATE '{X.AS_OF}') "
        + " ".join(f"WHEN {name} IN ('{m}', '{m[:3]}') THEN {i}" for i, m in enumerate(_NAMES, 1))
        + f" WHEN {name} = 'sept' THEN 9 END"
    )
    first = f"make_date({year}, {month}, 1)"
    return (
        f"CASE WHEN regexp_full_match({text}, '([a-z]+ ?)?\\d{{4}}') AND {month} IS NOT NULL"
        f" THEN CAST(least({first} + CAST(day(DATE '{X.AS_OF}') - 1 AS INT), last_day({first})) AS DATE) END"
    )


def parsed_sql(source: str, column: str) -> str:
    """Adds start_date, end_date, duration_months and is_current to the rows of ``source``."""
    return f"""SELECT *, CASE WHEN ok THEN s END AS start_date, CASE WHEN ok THEN e END AS end_date,
        CASE WHEN ok THEN greatest(0, (year(e) - year(s)) * 12 + month(e) - month(s)) END AS duration_months, ok AND cur AS is_current
        FROM (SELECT *, coalesce(len(parts) = 2 AND s IS NOT NULL AND e IS NOT NULL, false) AS ok FROM (
        SELECT *, {_point("trim(parts[1])")} AS s, trim(parts[2]) IN ('present', 'current', 'now') AS cur,
            CASE WHEN trim(parts[2]) IN ('present', 'current', 'now') THEN DATE '{X.AS_OF}' ELSE {_point("trim(parts[2])")} END AS e
        FROM (SELECT *, CASE WHEN contains(n, ' to ') THEN regexp_split_to_array(n, '\\s+to\\s+')
            WHEN contains(n, '-') THEN regexp_split_to_array(n, '\\s*-\\s*') END AS parts
        FROM (SELECT *, lower(regexp_replace(trim({column}), '[–—]', '-', 'g')) AS n FROM {source}))))"""


EXTRACTED = parsed_sql(f"({found_sql('resumes', 'candidate_id', RANGE_RE2)})", "match")
_DATES = "strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date"
F1 = f"""SELECT candidate_id, match_no AS rec_no, match AS date_range, {_DATES}, CAST(duration_months AS BIGINT) AS duration_months,
    is_current, {TITLE_SQL} AS job_title, {COMPANY_SQL} AS company, context FROM ({EXTRACTED})"""


def _ranges(spark, d):
    """The ranges of all resumes and, for each, spoilt and differently written forms of it."""
    found = X.resumes(spark, d).select(KEY, F.posexplode(matches("text", EMPLOYMENT_RANGE)).alias("no", "m"))
    plain = F.col("m.text")
    forms = F.array(
        plain,
        F.regexp_replace(plain, " - ", " – "),
        F.regexp_replace(plain, " - ", " to "),
        F.regexp_replace(plain, " - ", " and "),
        F.concat(plain, F.lit(" - 2001")),
        F.upper(F.regexp_replace(plain, " - ", "—")),
    )
    return found.select(KEY, "no", F.posexplode(forms).alias("form", "range"))


def f2_parse_range(spark, d):
    parsed = with_parsed_range(_ranges(spark, d), "range", F.lit(X.AS_OF).cast("date"))
    return parsed.select(KEY, *_b("no", "form"), "range", *_d("start_date", "end_date"), *_b("duration_months"), "is_current")


_FORMS = f"""SELECT candidate_id, match_no AS no, CAST(f - 1 AS BIGINT) AS form, forms[f] AS range FROM (
    SELECT *, unnest(generate_series(1, 6)) AS f, [match, replace(match, ' - ', ' – '), replace(match, ' - ', ' to '),
        replace(match, ' - ', ' and '), concat(match, ' - 2001'), upper(replace(match, ' - ', '—'))] AS forms
    FROM ({found_sql('resumes', 'candidate_id', RANGE_RE2)}))"""
F2 = f"""SELECT candidate_id, no, form, range, {_DATES}, CAST(duration_months AS BIGINT) AS duration_months, is_current
    FROM ({parsed_sql(f'({_FORMS})', 'range')})"""


def f3_order_history(spark, d):
    """Every fifth start is unknown."""
    start = F.when(F.col(REC) % 5 != 0, F.col("start_date"))
    ordered = E.order_history(_records(spark, d).withColumn("start_date", start), KEY, REC)
    return ordered.select(KEY, REC, *_b("position"))


F3 = """SELECT candidate_id, rec_id, row_number() OVER (PARTITION BY candidate_id
    ORDER BY coalesce(CASE WHEN rec_id % 5 <> 0 THEN start_date END, DATE '1900-01-01') DESC, rec_id) AS position FROM employment"""


def f4_employment_patterns(spark, d):
    patterns = E.employment_patterns(_records(spark, d), _candidates(spark, d), KEY)
    return patterns.select(
        KEY, *_b("total_experience", "job_count"),
        *_r("average_tenure", "average_tenure_years", "total_experience_years", "job_changing_frequency"),
    )


PATTERNS = f"""SELECT c.candidate_id, coalesce(avg_t, 0) AS average_tenure, coalesce(total, 0) AS total_experience, coalesce(n, 0) AS job_count,
    coalesce(n, 0) / CASE WHEN coalesce(total, 0) > 0 THEN total / 12 ELSE 1 END AS job_changing_frequency
    FROM ({CANDIDATES}) c LEFT JOIN (SELECT candidate_id, avg(duration_months) AS avg_t, CAST(sum(duration_months) AS BIGINT) AS total,
    count(*) AS n FROM employment GROUP BY candidate_id) e ON e.candidate_id = c.candidate_id"""
F4 = f"""SELECT candidate_id, total_experience, job_count, round(average_tenure, 6) AS average_tenure,
    round(average_tenure / 12, 6) AS average_tenure_years, round(total_experience / 12, 6) AS total_experience_years,
    round(job_changing_frequency, 6) AS job_changing_frequency FROM ({PATTERNS})"""


def f5_employment_gaps(spark, d):
    gaps = E.employment_gaps(_records(spark, d), key=KEY, record=REC)
    return gaps.select(KEY, *_d("start_date", "end_date"), *_b("gap_months"))


GAPS = """SELECT candidate_id, end_date AS gap_start, nxt AS gap_end, (year(nxt) - year(end_date)) * 12 + month(nxt) - month(end_date) - 1 AS gap_months
    FROM (SELECT *, lead(start_date) OVER (PARTITION BY candidate_id ORDER BY end_date, start_date DESC, rec_id) AS nxt FROM employment)
    WHERE (year(nxt) - year(end_date)) * 12 + month(nxt) - month(end_date) - 1 > 3"""
F5 = f"""SELECT candidate_id, strftime(gap_start, '%Y-%m-%d') AS start_date, strftime(gap_end, '%Y-%m-%d') AS end_date,
    CAST(gap_months AS BIGINT) AS gap_months FROM ({GAPS})"""


def _features(spark, d):
    return E.turnover_features(_records(spark, d), _candidates(spark, d), key=KEY, record=REC)


def f6_turnover_features(spark, d):
    return _features(spark, d).select(KEY, *_r(*E.FEATURES))


FEATURES = f"""SELECT p.candidate_id, average_tenure::DOUBLE AS average_tenure, total_experience::DOUBLE AS total_experience,
    job_count::DOUBLE AS job_count, job_changing_frequency::DOUBLE AS job_changing_frequency,
    CASE WHEN g.n > 0 THEN 1 ELSE 0 END::DOUBLE AS has_gaps, coalesce(g.n, 0)::DOUBLE AS gap_count, coalesce(g.m, 0)::DOUBLE AS avg_gap_duration
    FROM ({PATTERNS}) p LEFT JOIN (SELECT candidate_id, count(*) AS n, avg(gap_months) AS m FROM ({GAPS}) GROUP BY candidate_id) g
    ON g.candidate_id = p.candidate_id"""


def _rounded(names, digits=6, suffix=""):
    return ", ".join(f"round({n}, {digits}) AS {n}{suffix}" for n in names)


F6 = f"SELECT candidate_id, {_rounded(E.FEATURES)} FROM ({FEATURES})"


def g1_standardise(spark, d):
    return T.standardise(_features(spark, d)).select(KEY, *_r(*E.FEATURES))


G1 = f"SELECT candidate_id, " + ", ".join(
    f"round(({f} - avg({f}) OVER ()) / (stddev_samp({f}) OVER () + 1e-8), 6) AS {f}" for f in E.FEATURES
) + f" FROM ({FEATURES})"


def g2_feature_profile(spark, d):
    names = ["mean", "std", "min", "max", *[f"cov_{g}" for g in E.FEATURES]]
    return T.feature_profile(_features(spark, d)).select("feature", "n", *_r(*names, digits=5))


G2 = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) AS n, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS std, round(min({f}), 5) AS min,
    round(max({f}), 5) AS max, """
    + ", ".join(f"round(covar_samp({f}, {g}), 5) AS cov_{g}" for g in E.FEATURES)
    + f" FROM ({FEATURES})"
    for f in E.FEATURES
)


def g3_feature_contributions(spark, d):
    long = T.contributions_long(T.feature_contributions(_features(spark, d), "gradient_boosting"), KEY)
    return long.select(KEY, "feature", *_r("contribution"))


NORMS = {
    "average_tenure": "1 / (1 + exp(0.05 * (average_tenure - 30)))",
    "total_experience": "1 - ln(1 + total_experience) / ln(121)",
    "job_count": "least(1, job_count / 8)",
    "job_changing_frequency": "least(1, pow(job_changing_frequency, 0.8))",
    "has_gaps": "has_gaps",
    "gap_count": "least(1, gap_count / 3)",
    "avg_gap_duration": "least(1, avg_gap_duration / 18)",
}
# The base weights of each set add up to one, but for two sets that do so only after scaling.
_BASE = {
    "random_forest": (0.28, 0.12, 0.14, 0.22, 0.09, 0.06, 0.05, 0.02, 0.02),
    "gradient_boosting": (0.34, 0.08, 0.10, 0.28, 0.11, 0.04, 0.03, 0.01, 0.01),
}


def _weight(model: str, i: int) -> str:
    return f"CAST({_BASE[model][i]} AS DOUBLE) / {'(' + ' + '.join(map(str, _BASE[model])) + ')'}"


G3 = " UNION ALL ".join(
    f"SELECT candidate_id, '{f}' AS feature, round(({n}) * {_weight('gradient_boosting', i)}, 6) AS contribution FROM ({FEATURES})"
    for i, (f, n) in enumerate(NORMS.items())
)


def g4_turnover_weights(spark, d):
    """What every feature weighs in total over the batch, for each of the four weight sets."""
    weights = T.turnover_weights(spark)
    scored = T.contributions_long(T.feature_contributions(_features(spark, d)), KEY).select(KEY, "feature")
    counted = scored.groupBy("feature").agg(F.count("*").alias("n"))
    return weights.join(counted, "feature", "left").select(
        "model_type", "feature", F.round("weight", 6).alias("weight"), F.round(F.col("weight") * F.coalesce("n", F.lit(0)), 4).alias("total")
    )


_SETS = {
    **_BASE,
    "logistic_regression": (0.31, 0.13, 0.12, 0.26, 0.10, 0.04, 0.02, 0.01, 0.01),
    "other": (0.30, 0.15, 0.15, 0.21, 0.08, 0.05, 0.03, 0.015, 0.015),
}
G4 = (
    "SELECT model_type, feature, round(w / s, 6) AS weight, round(w / s * CASE WHEN scored THEN n ELSE 0 END, 4) AS total FROM (SELECT model_type, feature, scored,"
    " CAST(w AS DOUBLE) AS w, sum(CAST(w AS DOUBLE)) OVER (PARTITION BY model_type) AS s FROM (VALUES "
    + ", ".join(f"('{m}', '{f}', {str(f in E.FEATURES).lower()}, {w})" for m, ws in _SETS.items() for f, w in zip(T.WEIGHTED, ws))
    + f") AS t(model_type, feature, scored, w)), (SELECT 2 * count(*) AS n FROM customer)"
)


def _scored(spark, d):
    return T.turnover_score(_features(spark, d))


def g5_turnover_score(spark, d):
    return _scored(spark, d).select(KEY, *_r("leave_probability", "stay_probability"), "will_leave")


_Z = (
    " + ".join(f"({n}) * {_weight('random_forest', i)}" for i, n in enumerate(NORMS.values()))
    + " + CASE WHEN average_tenure < 24 AND job_changing_frequency > 0.3 THEN 0.05 ELSE 0 END"
    + " + CASE WHEN has_gaps > 0 AND average_tenure < 20 THEN 0.04 ELSE 0 END"
)
SCORED = f"SELECT *, greatest(0.01, least(0.99, 1 / (1 + exp(-2 * ({_Z}))))) AS p FROM ({FEATURES})"
G5 = f"""SELECT candidate_id, round(p, 6) AS leave_probability, round(1 - p, 6) AS stay_probability, p > 0.5 AS will_leave FROM ({SCORED})"""


def g6_feature_bands(spark, d):
    return T.feature_bands(_features(spark, d), KEY).select(KEY, "feature", *_r("value"), "band")


_BANDS = {
    "average_tenure": ("average_tenure / 12", "CASE WHEN average_tenure / 12 < 1.5 THEN 'high' WHEN average_tenure / 12 < 3 THEN 'medium' ELSE 'low' END"),
    "job_changing_frequency": (
        "job_changing_frequency",
        "CASE WHEN job_changing_frequency > 0.5 THEN 'high' WHEN job_changing_frequency > 0.2 THEN 'medium' ELSE 'low' END",
    ),
    "has_gaps": ("has_gaps", "CASE WHEN has_gaps > 0 THEN 'medium' ELSE 'low' END"),
}
G6 = " UNION ALL ".join(
    f"SELECT candidate_id, '{f}' AS feature, round({_BANDS.get(f, (f, ''))[0]}, 6) AS value, {_BANDS.get(f, (f, chr(39) + 'medium' + chr(39)))[1]} AS band FROM ({FEATURES})"
    for f in E.FEATURES
)


def g7_risk_level(spark, d):
    """Probabilities moved down by two fifths in part, so that all levels occur."""
    lowered = F.col("leave_probability") - F.when(F.col(KEY) % 3 == 0, 0.4).otherwise(0.0)
    return _scored(spark, d).select(KEY, T.risk_level(lowered).alias("risk_level"))


G7 = f"""SELECT candidate_id, CASE WHEN q > 0.7 THEN 'High' WHEN q > 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level
    FROM (SELECT candidate_id, p - CASE WHEN candidate_id % 3 = 0 THEN 0.4 ELSE 0 END AS q FROM ({SCORED}))"""


def g8_risk_insights(spark, d):
    return _features(spark, d).select(KEY, F.array_join(T.risk_insights(), ",").alias("insights"))


G8 = f"""SELECT candidate_id, concat_ws(',',
    CASE WHEN average_tenure / 12 < 1.5 THEN 'short_tenure' WHEN average_tenure / 12 > 4 THEN 'long_tenure' END,
    CASE WHEN job_changing_frequency > 0.5 THEN 'frequent_changes' WHEN job_changing_frequency < 0.2 AND job_count > 2 THEN 'steady_changes' END,
    CASE WHEN gap_count > 1 THEN 'several_gaps' WHEN gap_count = 1 THEN 'one_gap' END) AS insights FROM ({FEATURES})"""


def g9_risk_recommendations(spark, d):
    return T.risk_recommendations(_scored(spark, d), KEY).select(KEY, "risk_level", *_b("item"), "recommendation")


_ADVICE = X.sql_values(
    [(level, i, t) for level, ts in T.RECOMMENDATIONS.items() for i, t in enumerate(ts, 1)], "risk_level, item, recommendation"
)
G9 = f"""SELECT candidate_id, s.risk_level, CAST(item AS BIGINT) AS item, recommendation FROM (SELECT candidate_id,
    CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level FROM ({SCORED})) s
    JOIN ({_ADVICE}) a ON a.risk_level = s.risk_level"""


def g10_history_only(spark, d):
    kept = T.history_only(_features(spark, d), KEY)
    return kept.select(KEY, *_r("average_tenure"), "leave_probability", "stay_probability", "will_leave", "risk_level")


G10 = f"""SELECT candidate_id, round(average_tenure, 6) AS average_tenure, 0::DOUBLE AS leave_probability, 1::DOUBLE AS stay_probability,
    false AS will_leave, 'Unknown' AS risk_level FROM ({PATTERNS})"""

QUERIES = {
    "f1_extract_employment": f1_extract_employment,
    "f2_parse_range": f2_parse_range,
    "f3_order_history": f3_order_history,
    "f4_employment_patterns": f4_employment_patterns,
    "f5_employment_gaps": f5_employment_gaps,
    "f6_turnover_features": f6_turnover_features,
    "g1_standardise": g1_standardise,
    "g2_feature_profile": g2_feature_profile,
    "g3_feature_contributions": g3_feature_contributions,
    "g4_turnover_weights": g4_turnover_weights,
    "g5_turnover_score": g5_turnover_score,
    "g6_feature_bands": g6_feature_bands,
    "g7_risk_level": g7_risk_level,
    "g8_risk_insights": g8_risk_insights,
    "g9_risk_recommendations": g9_risk_recommendations,
    "g10_history_only": g10_history_only,
}
ORACLE = {
    name: X.oracle(sql)
    for name, sql in {
        "f1_extract_employment": F1,
        "f2_parse_range": F2,
        "f3_order_history": F3,
        "f4_employment_patterns": F4,
        "f5_employment_gaps": F5,
        "f6_turnover_features": F6,
        "g1_standardise": G1,
        "g2_feature_profile": G2,
        "g3_feature_contributions": G3,
        "g4_turnover_weights": G4,
        "g5_turnover_score": G5,
        "g6_feature_bands": G6,
        "g7_risk_level": G7,
        "g8_risk_insights": G8,
        "g9_risk_recommendations": G9,
        "g10_history_only": G10,
    }.items()
}
