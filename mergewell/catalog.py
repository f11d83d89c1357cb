"""Registered queries over the driver's tables and their SQL twins.

The Spark side runs the operators; the SQL says independently what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.operators import clustering, extract, matching, merging, output, scoring
from mergewell.operators.normalize import normalize
from mergewell.plans.run import run
from mergewell.plans.synthetic import SQL, records

PRIORITIES = {"github": 8, "resume": 8, "json": 7, "csv": 5}
CONFIG = {
    "output_fields": [{"name": "candidate_id", "required": True}, {"name": "full_name", "required": True}, {"name": "emails"}, {"name": "phones"}, {"name": "headline"}, {"name": "overall_confidence"}],
    "field_renaming": {"full_name": "name"},
    "source_priorities": PRIORITIES,
}
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _merged(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> DataFrame:
    """Merged records by the rules on shared keys, as the SQL of the queries states them; with ``fuzzy`` by all rules."""
    rows = normalize(records(spark, sf_dir))
    clusters = clustering.components(rows, matching.linked(rows) if fuzzy else matching.matches(rows, fuzzy=False))
    return scoring.score(merging.merge(rows, clusters, PRIORITIES))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified candidates with their confidence and validated JSON."""
    result = run(records(spark, sf_dir), CONFIG)
    return result.output.select("cluster_id", "output", F.size("validation").alias("n_errors"))


# ---- scalar functions


@query(f"WITH {SQL} SELECT record_idx, email FROM r WHERE email IS NOT NULL")
def q_email_norm(spark, sf_dir):
    return records(spark, sf_dir).select("record_idx", F.explode("emails").alias("e")).select("record_idx", S.email(F.col("e")).alias("email"))


@query(f"WITH {SQL} SELECT record_idx, phone FROM r WHERE phone IS NOT NULL")
def q_phone_norm(spark, sf_dir):
    return records(spark, sf_dir).select("record_idx", F.explode("phones").alias("p")).select("record_idx", S.phone(F.col("p")).alias("phone"))


@query(f"""WITH {SQL}, s AS (SELECT record_idx, unnest(string_split(skills, '|')) AS s FROM r WHERE skills <> '')
SELECT DISTINCT record_idx, CASE lower(s) WHEN 'py' THEN 'Python' WHEN 'python 3' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'node-js' THEN 'Node.js' WHEN 'spark' THEN 'Spark' ELSE s END AS skill FROM s""")
def q_skill_norm(spark, sf_dir):
    return normalize(records(spark, sf_dir)).select("record_idx", F.explode("skills").alias("skill"))


@query("""SELECT n_nationkey AS k, regexp_replace(n_name, '^\\s+|\\s+$', '', 'g') AS city,
CASE n_nationkey % 3 WHEN 0 THEN 'North, East' END AS region, CASE n_nationkey % 3 WHEN 0 THEN 'United Kingdom' WHEN 1 THEN 'United States' END AS country FROM nation""")
def q_location_norm(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(" , North, East ,  U.K."), F.lit(",u.s.a."), F.lit(" ")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    place = S.location(F.concat(F.lit(" "), "n_name", tail))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), place.alias("p")).select("k", "p.city", "p.region", "p.country")


@query("""WITH u AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^www\\.', '')) AS h FROM pages)
SELECT page_id, url, CASE WHEN h IN ('facebook.com','instagram.com','x.com','twitter.com','youtube.com') THEN 'other' ELSE 'portfolio' END AS category FROM u WHERE h <> ''""")
def q_link_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.link(F.col("url")).alias("l")).where("l is not null").select("page_id", "l.url", "l.category")


@query("""SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^(www|WWW)\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS key FROM pages""")
def q_url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.url_key(F.col("url")).alias("key"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def q_date_norm(spark, sf_dir):
    at = F.col("o_orderdate")
    shown = F.element_at(F.array(*[F.date_format(at, f) for f in ("yyyy-MM-dd", "MMM yyyy", "MMMM d, yyyy", "d MMM yyyy")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.date(F.concat(F.lit(" "), shown)).alias("d"))


@query("""WITH w AS (SELECT doc_id, w, row_number() OVER () AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) ORDER BY doc_id, i)
SELECT doc_id, count(DISTINCT replace(lower(w), 'ß', 'ss')) AS n FROM w GROUP BY doc_id""")
def q_dedup_ci(spark, sf_dir):
    """Distinct words of each document, by exploded keys: texts are too long for a list function."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id").agg(F.count_distinct(S.fold(F.col("w"))).alias("n"))


@query(f"WITH {SQL} SELECT record_idx, lower(full_name) AS key FROM r WHERE full_name IS NOT NULL")
def q_name_key(spark, sf_dir):
    return records(spark, sf_dir).where("full_name is not null").select("record_idx", S.name_key(F.col("full_name")).alias("key"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_path(spark, sf_dir):
    from mergewell.sources.nested import first_present

    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(first_present(v, ("missing.key", "k")), "$", "bigint").alias("k"))


# ---- extraction


@query("""WITH m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS email FROM documents) SELECT * FROM m""")
def q_extract_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.emails(F.col("text"))).alias("email"))


@query("""SELECT conv_id, turn, count(*) AS n_lines FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE regexp_matches(l, '[^\\s]') GROUP BY 1, 2""")
def q_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(extract.lines_of(F.col("text"))).cast("long").alias("n_lines")).where("n_lines > 0")


@query("""SELECT c_custkey AS k, 'Engineer' AS first_line, 2 AS n FROM customer""")
def q_sections(spark, sf_dir):
    text = F.concat(F.lit("Ada\nSummary:\nLikes "), "c_name", F.lit("\n\nWork Experience\nEngineer\nAnalyst at "), "c_mktsegment", F.lit("\nSkills\nPython, SQL"))
    found = extract.section(extract.lines_of(text), "experience")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.get(found, 0).alias("first_line"), F.size(found).alias("n"))


@query("""SELECT c_custkey AS k, col AS source_key, v AS value FROM (SELECT c_custkey, 'c_name' AS col, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer) WHERE v <> ''""")
def q_raw_unpivot(spark, sf_dir):
    from mergewell.sources.delimited import ColumnMapping, from_frame

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_idx"), "c_name", "c_mktsegment")
    out = from_frame(rows, ColumnMapping(full_name="c_name", current_company="c_mktsegment"))
    return out.select(F.col("record_idx").alias("k"), F.explode("raw_values").alias("v")).select("k", "v.source_key", "v.value")


# ---- matching and clustering


def _pairs(column: str) -> str:
    return f"WITH {SQL} SELECT a.record_idx AS left_idx, b.record_idx AS right_idx FROM r a JOIN r b ON a.{column} = b.{column} AND a.record_idx > b.record_idx"


def _key_pairs(spark, sf_dir, keys) -> DataFrame:
    rows = normalize(records(spark, sf_dir))
    return matching.all_pairs(matching.keyed(rows, keys)).select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx")).distinct()


@query(_pairs("email"))
def q_match_email(spark, sf_dir):
    return _key_pairs(spark, sf_dir, matching.email_keys())


@query(_pairs("phone"))
def q_match_phone(spark, sf_dir):
    return _key_pairs(spark, sf_dir, matching.phone_keys())


@query(_pairs("url"))
def q_match_url(spark, sf_dir):
    return _key_pairs(spark, sf_dir, matching.urls("github.com"))


@query(f"""WITH {SQL}, p AS (
SELECT a.record_idx AS l, b.record_idx AS r, 1 AS rule, 1.0::DOUBLE AS c FROM r a JOIN r b ON a.email = b.email AND a.record_idx > b.record_idx
UNION ALL SELECT a.record_idx, b.record_idx, 2, 0.98 FROM r a JOIN r b ON a.phone = b.phone AND a.record_idx > b.record_idx
UNION ALL SELECT a.record_idx, b.record_idx, 3, 0.94 FROM r a JOIN r b ON a.url = b.url AND a.record_idx > b.record_idx)
SELECT l AS left_idx, r AS right_idx, min(rule) AS rule, arg_min(c, rule) AS confidence FROM p GROUP BY 1, 2""")
def q_match_first_rule(spark, sf_dir):
    found = matching.matches(normalize(records(spark, sf_dir)), fuzzy=False)
    return found.select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "rule", "confidence")


@query(f"WITH {SQL} SELECT record_idx, min(record_idx) OVER (PARTITION BY k) AS cluster_id FROM r")
def q_components(spark, sf_dir):
    rows = normalize(records(spark, sf_dir))
    return clustering.components(rows, matching.matches(rows, fuzzy=False))


@query(f"""WITH {SQL} SELECT k * 4 AS cluster_id, count(*) AS size, max(record_idx) AS latest FROM r GROUP BY k""")
def q_cluster_order(spark, sf_dir):
    rows = normalize(records(spark, sf_dir))
    return clustering.ordered(clustering.components(rows, matching.matches(rows, fuzzy=False)))


@query()
def q_match_all_rules(spark, sf_dir):
    """Every pair by the first of all rules, similarity among them; here and below the measure is beyond SQL."""
    found = matching.matches(normalize(records(spark, sf_dir)), complete=True)
    return found.select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "rule", "confidence")


@query()
def q_components_all_rules(spark, sf_dir):
    rows = normalize(records(spark, sf_dir))
    return clustering.components(rows, matching.linked(rows))


@query()
def q_cluster_order_all_rules(spark, sf_dir):
    return clustering.ordered(q_components_all_rules(spark, sf_dir))


@query()
def q_merged_all_rules(spark, sf_dir):
    """What the queries on merged records show, with clusters by all rules."""
    return _merged(spark, sf_dir, fuzzy=True)


@query()
def q_merge_report_all_rules(spark, sf_dir):
    return output.merge_report(normalize(records(spark, sf_dir)), q_components_all_rules(spark, sf_dir))


@query()
def q_name_similarity(spark, sf_dir):
    """All pairs of suppliers' names and how alike they are; the measure is beyond SQL, tests hold it to worked values."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_idx"), S.name_key(F.col("s_name")).alias("name"))
    return matching.scored_names(s).select(F.col("left").alias("k"), F.col("right").alias("other"), "score")


# ---- merging, scoring, provenance

_RANKED = f"""WITH {SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY -(CASE kind WHEN 'github' THEN 8 WHEN 'resume' THEN 8 WHEN 'json' THEN 7 ELSE 5 END), kind, label, external_id) AS rk FROM r)"""


@query(_RANKED + " SELECT record_idx, k * 4 AS cluster_id, rk AS place FROM q")
def q_priority_rank(spark, sf_dir):
    m = _merged(spark, sf_dir).select("cluster_id", F.posexplode("members").alias("at", "record_idx"))
    return m.select("record_idx", "cluster_id", (F.col("at") + 1).cast("long").alias("place"))


@query(_RANKED + " SELECT k * 4 AS cluster_id, arg_min(external_id, rk) AS external_id, arg_min(full_name, rk) FILTER (full_name IS NOT NULL) AS full_name, arg_min(headline, rk) FILTER (headline IS NOT NULL) AS headline, max(years) AS years_experience FROM q GROUP BY k")
def q_merge_scalars(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", "external_id", "full_name", "headline", "years_experience")


@query(_RANKED + """, e AS (SELECT k, rk, i, CASE lower(s) WHEN 'py' THEN 'Python' WHEN 'python 3' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'node-js' THEN 'Node.js' WHEN 'spark' THEN 'Spark' ELSE s END AS s FROM (SELECT k, rk, unnest(string_split(skills, '|')) AS s, generate_subscripts(string_split(skills, '|'), 1) AS i FROM q WHERE skills <> '')),
f AS (SELECT k, s, min(rk * 100 + i) AS o FROM e GROUP BY k, s) SELECT k * 4 AS cluster_id, string_agg(s, '|' ORDER BY o) AS skills FROM f GROUP BY k""")
def q_merge_lists(spark, sf_dir):
    return _merged(spark, sf_dir).where("size(skills) > 0").select("cluster_id", F.array_join("skills", "|").alias("skills"))


@query(_RANKED + " SELECT k * 4 AS cluster_id, string_agg(label, '>' ORDER BY rk) AS lineage FROM q GROUP BY k")
def q_merge_lineage(spark, sf_dir):
    return _merged(spark, sf_dir).select("cluster_id", F.array_join(F.transform("merged_from", lambda x: x["label"]), ">").alias("lineage"))


@query(f"""WITH {SQL}, s AS (SELECT k, max(CASE WHEN kind = 'json' THEN 1 ELSE 0 END) AS j, max(CASE WHEN kind = 'github' THEN 1 ELSE 0 END) AS g, max(CASE WHEN kind = 'resume' THEN 1 ELSE 0 END) AS x FROM r GROUP BY k)
SELECT k * 4 AS cluster_id, round(1 - 0.4::DOUBLE * (CASE j WHEN 1 THEN 0.3 ELSE 1 END)::DOUBLE, 4) AS emails, round(1 - 0.4::DOUBLE * (CASE x WHEN 1 THEN 0.3 ELSE 1 END)::DOUBLE, 4) AS phones, CASE g WHEN 1 THEN round(1 - 0.4::DOUBLE * (1 - 0.8::DOUBLE), 4) ELSE 0.6 END AS skills FROM s""")
def q_field_confidence(spark, sf_dir):
    c = lambda f: F.element_at("field_confidence", F.lit(f)).alias(f)
    return _merged(spark, sf_dir).select("cluster_id", c("emails"), c("phones"), c("skills"))


def _or(flags: dict[str, float]) -> str:
    """1 less the product of doubts of the sources that a cluster has."""
    return "1 - " + " * ".join(f"(CASE {c} WHEN 1 THEN 1 - {w}::DOUBLE ELSE 1.0::DOUBLE END)" for c, w in flags.items())


@query(f"""WITH {SQL}, s AS (SELECT k, 1 AS c, max(CASE WHEN kind = 'json' THEN 1 ELSE 0 END) AS j, max(CASE WHEN kind = 'github' THEN 1 ELSE 0 END) AS g, max(CASE WHEN kind = 'resume' THEN 1 ELSE 0 END) AS x, max(years) AS y FROM r GROUP BY k),
f AS (SELECT *, {_or({"c": 0.6, "j": 0.7, "g": 0.8, "x": 0.7})} AS everyone FROM s),
v AS (
  SELECT k, unnest([0.8, 1.0, 1.0, 0.9, 0.5, 0.8, 0.4, 0.5, 0.7, 0.8, 0.3]::DOUBLE[]) AS w, unnest([
    CASE WHEN j = 1 AND g = 1 THEN round({_or({"j": 0.7, "g": 0.8})}, 4) WHEN j = 1 THEN round(1 - (1 - 0.7::DOUBLE), 4) WHEN g = 1 THEN round(1 - (1 - 0.8::DOUBLE), 4) ELSE round(everyone, 4) END,
    0.6::DOUBLE, round({_or({"c": 0.6, "j": 0.7})}, 4), round({_or({"c": 0.6, "x": 0.7})}, 4), round(everyone, 4),
    CASE WHEN g = 1 THEN round(everyone, 4) END, CASE WHEN j = 1 THEN 0.7::DOUBLE END, CASE WHEN y IS NOT NULL THEN round(everyone, 4) END,
    round({_or({"c": 0.6, "g": 0.8})}, 4), round(everyone, 4), CASE WHEN x = 1 THEN 0.7::DOUBLE END]::DOUBLE[]) AS c FROM f)
SELECT k * 4 AS cluster_id, round(round(sum(w * c) / sum(w), 4), 3) AS overall_confidence FROM v WHERE c IS NOT NULL GROUP BY k""")
def q_overall_confidence(spark, sf_dir):
    """The weighted mean over present fields, to three places: sums in another order may differ in the last."""
    return _merged(spark, sf_dir).select("cluster_id", F.round("overall_confidence", 3).alias("overall_confidence"))


@query(f"""WITH {SQL}, p AS (SELECT k, kind, label FROM r)
SELECT k * 4 AS cluster_id, 'emails' AS field, label AS source, 'emails' AS source_key FROM p WHERE kind IN ('csv', 'json')
UNION ALL SELECT k * 4, 'phones', label, 'phones' FROM p WHERE kind IN ('csv', 'resume')
UNION ALL SELECT k * 4, 'skills', label, CASE kind WHEN 'csv' THEN 'skills' ELSE 'languages' END FROM p WHERE kind IN ('csv', 'github')""")
def q_provenance(spark, sf_dir):
    return scoring.provenance_rows(_merged(spark, sf_dir)).where("field in ('emails', 'phones', 'skills')").select("cluster_id", "field", "source", "source_key")


# ---- output


@query("SELECT c_custkey * 4 AS cluster_id, c_mktsegment AS company, 'Engineer' AS title FROM customer")
def q_canonical_experience(spark, sf_dir):
    return output.canonical(_merged(spark, sf_dir)).select("cluster_id", F.explode("experience").alias("e")).select("cluster_id", "e.company", "e.title")


def _projected(strategy: str):
    def f(spark, sf_dir):
        config = {"output_fields": [{"name": "full_name", "required": True}, {"name": "headline"}], "field_renaming": {"full_name": "name"}, "missing_value_strategy": strategy}
        return output.project(output.canonical(_merged(spark, sf_dir)), config).select("cluster_id", "output")

    f.__name__ = f"q_project_{strategy}"
    tail = {"keep_null": "',\"headline\":null'", "omit": "''", "empty_string": "',\"headline\":\"\"'"}[strategy]
    sql = f"""WITH {SQL}, s AS (SELECT k, max(full_name) AS n, max(headline) AS h FROM r GROUP BY k)
SELECT k * 4 AS cluster_id, '{{"name":"' || n || '"' || CASE WHEN h IS NULL THEN {tail} ELSE ',"headline":"' || h || '"' END || '}}' AS output FROM s"""
    return query(sql)(f)


for _strategy in output.STRATEGIES:
    _projected(_strategy)


@query(f"""WITH {SQL} SELECT k * 4 AS cluster_id, CASE WHEN max(headline) IS NULL THEN 1 ELSE 0 END AS n_errors FROM r GROUP BY k""")
def q_validate(spark, sf_dir):
    config = {"output_fields": [{"name": "full_name", "required": True}, {"name": "headline", "required": True}]}
    out = output.validate(output.project(output.canonical(_merged(spark, sf_dir)), config), config)
    return out.select("cluster_id", F.size("validation").alias("n_errors"))


@query(f"WITH {SQL}, s AS (SELECT count(*) AS n, count(DISTINCT k) AS c FROM r) SELECT n AS records_read, c AS canonical_records, n - c AS duplicates, round((n - c)::DOUBLE / n, 4) AS reduction FROM s")
def q_merge_report(spark, sf_dir):
    rows = normalize(records(spark, sf_dir))
    return output.merge_report(rows, clustering.components(rows, matching.matches(rows, fuzzy=False)))


@query(_RANKED + " SELECT k * 4 AS cluster_id, string_agg(label, ',' ORDER BY rk) AS sources FROM q GROUP BY k")
def q_contributing_sources(spark, sf_dir):
    return output.contributing(_merged(spark, sf_dir)).select("cluster_id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {SQL} SELECT k * 4 AS cluster_id, full_name AS name, email, 'valid' AS status FROM r WHERE kind = 'csv' AND lower(full_name) LIKE '%grace%'")
def q_dashboard(spark, sf_dir):
    return output.dashboard(output.canonical(_merged(spark, sf_dir)), "Grace", "valid").select("cluster_id", "name", "email", "status")


@query(f"WITH {SQL} SELECT k * 4 AS cluster_id, 'github' AS type, 'https://github.com/dev' || k AS url FROM r WHERE kind = 'github'")
def q_links_by_type(spark, sf_dir):
    return output.links_by_type(output.canonical(_merged(spark, sf_dir)))


@query(f"WITH {SQL} SELECT full_name AS name, max(k * 4) AS cluster_id FROM r WHERE kind = 'csv' GROUP BY 1")
def q_name_lookup(spark, sf_dir):
    return output.by_name(output.canonical(_merged(spark, sf_dir)))


@query(f"WITH {SQL} SELECT record_idx AS resume_idx, k * 4 AS record_idx, 3 AS rule FROM r WHERE kind = 'resume'")
def q_resume_first_hit(spark, sf_dir):
    rows = normalize(records(spark, sf_dir))
    return output.resume_matches(rows.where("source.source_type = 'csv'"), rows.where("source.source_type = 'resume'"))


@query(f"WITH {SQL} SELECT record_idx, coalesce(headline, 'Filled') AS headline, CASE WHEN k % 3 = 0 THEN 'enriched' ELSE 'unavailable' END AS status FROM r WHERE headline IS NOT NULL OR k % 3 = 0")
def q_fill_missing(spark, sf_dir):
    rows = records(spark, sf_dir)
    given = rows.where("floor(record_idx / 4) % 3 = 0").select("record_idx", F.lit("Filled").alias("headline"), F.array(F.lit("Go")).alias("skills"))
    return output.fill_missing(rows, given, ("headline",), ("skills",)).where("headline is not null").select("record_idx", "headline", "status")


@query("""SELECT c_custkey AS record_idx, 'dev' || c_custkey AS external_id, 'Rust' AS skill FROM customer WHERE c_custkey % 2 = 0""")
def q_profile_lookup(spark, sf_dir):
    from mergewell.sources.nested import code_profiles

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_idx"))
    links = c.select("record_idx", F.concat(F.lit("https://github.com/dev"), "record_idx", F.lit("?tab=x")).alias("url"))
    known = c.where("record_idx % 2 = 0").select(F.concat(F.lit("dev"), "record_idx").alias("login"))
    known = known.select("login", F.try_parse_json(F.to_json(F.struct("login"))).alias("v"), F.array(F.try_parse_json(F.lit('{"name":"a","language":"Rust"}'))).alias("repos"))
    found, _ = code_profiles(links, known)
    return found.select("record_idx", "external_id", F.get("skills", 0).alias("skill"))
