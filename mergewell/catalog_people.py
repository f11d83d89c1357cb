"""Registered queries of the record operators that the shared synthetic sources do not reach, and their SQL twins.

Each renders its input from a driver's table; the SQL says from the same table what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mergewell.catalog import ORACLE_SQL, PRIORITIES, QUERIES, _merged, query, table
from mergewell.functions import scalars as S
from mergewell.operators import clustering, enrich, extract, matching, merging, output, scoring, sinks
from mergewell.operators.normalize import normalize
from mergewell.plans.synthetic import SQL, folder, records
from mergewell.sources import delimited, nested
from mergewell.sources.records import append, as_records, source, split_valid

__all__ = ["ORACLE_SQL", "QUERIES"]
AT = "2024-01-01 00:00:00"


def _customers(spark, sf_dir) -> DataFrame:
    """Customers dealt to all tasks: a small file is one split, but what is made of its rows is not small."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("c_name")).repartition(tasks, "k")


def _k(prefix: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col("k"), F.lit(suffix))


def _get(items: str, i: int, key: str) -> Column:
    return F.get_json_object(F.get(items, i), f"$.{key}")


def _own(df: DataFrame, kind: str = "csv", name: str = "recruiter_csv", **columns: Column) -> DataFrame:
    columns = {"record_idx": F.col("k"), "source": source(kind, name, F.col("k"), F.lit(None).cast("string"), AT)} | columns
    return as_records(df, **columns)


# ---- résumés


def _resume_text() -> Column:
    head = F.concat(F.lit("Ada Lovelace\nBerlin, Germany\nada"), "k", F.lit("@example.com | +1 415 555 "), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.lit("\nhttps://github.com/ada"), "k", F.lit("."))
    body = F.concat(F.lit("\nSummary:\nBuilds things\nfor "), "seg", F.lit("\n\nWork Experience\nEngineer at "), "seg", F.lit(" - Jan 2020 - Present\nabc\nAnalyst, Acme 2018 - 2019\nEducation\nMIT, BS in Physics, 2019\nX"))
    tail = F.concat(F.lit("\nProjects\n- Engine"), "k", F.lit(": computes\nab\nCertifications\n- AWS "), F.col("k") % 5, F.lit("\n* aws "), F.col("k") % 5, F.lit("\nSkills\nPython, SQL and java"))
    return F.concat(head, body, tail)


def _resumes(spark, sf_dir) -> DataFrame:
    return extract.resumes(_customers(spark, sf_dir).select(F.col("k").alias("record_idx"), F.concat(F.lit("cv/Ada."), "k", F.lit(".PDF")).alias("path"), _resume_text().alias("text")))


@query("""SELECT c_custkey AS k, 'Ada Lovelace' AS full_name, 'Berlin, Germany' AS location, 'ada' || c_custkey || '@example.com' AS email, '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
'https://github.com/ada' || c_custkey AS link, 'Python|Java|SQL' AS skills, 'Builds things for ' || c_mktsegment AS summary, 'Builds things for ' || c_mktsegment AS headline, 'AWS ' || (c_custkey % 5) AS certifications,
'Ada.' || c_custkey || '.PDF' AS file, 'Ada.' || c_custkey || '.PDF' AS record_id, 'ada' || c_custkey || '@example.com' AS external_id, 10 AS n_raw FROM customer""")
def q_resume_fields(spark, sf_dir):
    r = _resumes(spark, sf_dir)
    return r.select(
        F.col("record_idx").alias("k"), "full_name", "location", F.array_join("emails", "|").alias("email"), F.array_join("phones", "|").alias("phone"), F.array_join("links", "|").alias("link"), F.array_join("skills", "|").alias("skills"),
        F.col("resume_summary").alias("summary"), "headline", F.array_join("certifications", "|").alias("certifications"), F.col("resume_file").alias("file"), F.col("source.source_record_id").alias("record_id"), "external_id", F.size("raw_values").alias("n_raw"),
    )


@query("""SELECT c_custkey AS k, 2 AS n_experience, 'Engineer' AS title, c_mktsegment AS company, 'Jan 2020 - Present' AS duration, '2020-01' AS s, CAST(NULL AS VARCHAR) AS e, CAST(NULL AS VARCHAR) AS company2, '2018 - 2019' AS duration2, '2018' AS s2, '2019' AS e2,
1 AS n_education, 'MIT' AS institution, 'BS in Physics' AS degree, '2019' AS year, 1 AS n_projects, 'Engine' || c_custkey AS project, '- Engine' || c_custkey || ': computes' AS description FROM customer""")
def q_resume_entries(spark, sf_dir):
    x = lambda i, key, name: _get("experience", i, key).alias(name)
    return _resumes(spark, sf_dir).select(
        F.col("record_idx").alias("k"), F.size("experience").alias("n_experience"), x(0, "title", "title"), x(0, "company", "company"), x(0, "duration", "duration"), x(0, "start", "s"), x(0, "end", "e"),
        x(1, "company", "company2"), x(1, "duration", "duration2"), x(1, "start", "s2"), x(1, "end", "e2"),
        F.size("education").alias("n_education"), _get("education", 0, "institution").alias("institution"), _get("education", 0, "degree").alias("degree"), _get("education", 0, "graduation_year").alias("year"),
        F.size("projects").alias("n_projects"), _get("projects", 0, "name").alias("project"), _get("projects", 0, "description").alias("description"),
    )


_RESUME_SQL = """
SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer"""


def _resume_stage(spark, sf_dir):
    c = _customers(spark, sf_dir).withColumn("m", F.col("k") % 5)
    people = _own(c, external_id=_k("C"), full_name=F.concat(F.lit("Person"), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij")), emails=F.array(_k("p", "@x.org")), phones=F.array(F.concat(F.lit("+919"), F.lpad(F.col("k").cast("string"), 9, "0"))), resume_file=F.when(F.col("m") == 0, _k("up/CV", ".pdf")))
    by = [F.lit("Summary\nnothing"), F.concat(_k("p", "@x.org"), F.lit("\nSummary\nby mail")), F.concat(F.lit("+91 9"), F.lpad(F.col("k").cast("string"), 9, "0"), F.lit("\nSummary\nby phone")), F.concat(F.lit("Person"), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij"), F.lit("\nSummary\nby name")), F.lit(" \n ")]
    text = F.element_at(F.array(*by), (F.col("m") + 1).cast("int"))
    docs = c.select(F.col("k").alias("record_idx"), F.when(F.col("m") == 0, _k("/tmp/cv", ".PDF")).when((F.col("m") == 4) & (F.col("k") % 2 == 0), F.concat(F.lit("/tmp/cv"), F.col("k") + 1, F.lit(".pdf"))).otherwise(_k("/tmp/other", ".pdf")).alias("path"), text.alias("text"))
    return people, docs


@query(f"WITH c AS ({_RESUME_SQL}) SELECT k AS resume_idx, k AS record_idx, m + 1 AS rule FROM c WHERE m < 4")
def q_resume_rules(spark, sf_dir):
    """By file name, e-mail, phone and name, each for a fifth of the résumés; the last fifth has no text.

    The names are letters for digits, so that 90 of 100 needs the same name."""
    people, docs = _resume_stage(spark, sf_dir)
    good, _ = split_valid(extract.resumes(docs))
    out = output.resume_matches(people, good, names=False)
    exact = good.join(people.select(F.col("full_name"), F.col("record_idx").alias("r")), "full_name").select(F.col("record_idx").alias("resume_idx"), F.col("r").alias("record_idx"), F.lit(4).alias("rule"))
    exact = exact.join(out, "resume_idx", "left_anti")
    return out.union(exact).select("resume_idx", "record_idx", F.col("rule").cast("long").alias("rule"))


@query(f"WITH c AS ({_RESUME_SQL}) SELECT CASE WHEN k % 2 = 0 THEN 'cv' || (k + 1) || '.pdf' ELSE 'other' || k || '.pdf' END AS resume_file, CASE WHEN k % 2 = 0 AND k + 1 <= (SELECT max(k) FROM c) THEN 'Person' || translate(CAST(k + 1 AS VARCHAR), '0123456789', 'abcdefghij') END AS candidate FROM c WHERE m = 4")
def q_resume_failures(spark, sf_dir):
    people, docs = _resume_stage(spark, sf_dir)
    _, failures = enrich.add_resumes(people, docs.where("record_idx % 5 = 4"))
    return failures.select("resume_file", "candidate")


@query(f"WITH c AS ({_RESUME_SQL}) SELECT k, 'C' || k AS matched FROM c WHERE m = 1")
def q_resume_annotated(spark, sf_dir):
    people, docs = _resume_stage(spark, sf_dir)
    both, _ = enrich.add_resumes(people.where("record_idx % 5 = 1"), docs.where("record_idx % 5 = 1"))
    told = both.where("source.source_type = 'resume'")
    return told.select(F.regexp_extract("resume_file", "([0-9]+)", 1).cast("long").alias("k"), F.get_json_object("raw_payload", "$.matched_candidate.external_id").alias("matched"))


# ---- scans


@query("""SELECT c_custkey AS k, 'C' || c_custkey AS external_id, c_name AS full_name, 'a' || c_custkey || '@x.org|B@y.org' AS emails, '555|666' AS phones, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE 'Lead' END AS headline,
CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN -2.0 ELSE 4.5 END AS years, 'Go|Rust' AS skills, CASE c_custkey % 2 WHEN 0 THEN 'own words' END AS raw_experience, CASE c_custkey % 2 WHEN 1 THEN c_mktsegment END AS company, 'MIT' AS education,
CASE WHEN c_custkey % 5 = 0 THEN 'years_experience is not a number' WHEN c_custkey % 7 = 0 THEN 'years_experience is not a number from 0 on' END AS error FROM customer""")
def q_delimited_rows(spark, sf_dir):
    c = _customers(spark, sf_dir)
    cell = lambda x: F.lit(x)
    rows = c.select(
        F.col("k").alias("record_idx"), _k("C").alias("candidate_id"), cell("").alias("full_name"), F.col("c_name").alias("name"), F.concat(_k("a", "@x.org"), F.lit(",, B@y.org")).alias("emails"), 
        cell(" b@y.org").alias("email"), cell("555").alias("phones"), cell("666, ").alias("phone"), F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.lit("Lead")).alias("headline"), F.col("seg").alias("title"),
        F.when(F.col("k") % 5 == 0, "senior").when(F.col("k") % 7 == 0, "-2").otherwise("").alias("years_experience"), cell(" 4.5 ").alias("total_experience"), cell("Go,Rust,go").alias("skills"), F.when(F.col("k") % 2 == 0, "own words").otherwise("").alias("experience"), F.col("seg").alias("current_company"), cell("MIT").alias("education"),
    )
    out = delimited.from_frame(rows)
    return out.select(
        F.col("record_idx").alias("k"), "external_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "headline", F.col("years_experience").alias("years"), F.array_join("skills", "|").alias("skills"),
        _get("experience", 0, "raw").alias("raw_experience"), _get("experience", 0, "company").alias("company"), _get("education", 0, "raw").alias("education"), "error",
    )


@query("""SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'N' || c_custkey END AS external_id, c_name AS full_name, 'a' || c_custkey || '@x.org|b@x.org' AS emails, CASE c_custkey % 2 WHEN 0 THEN '555' ELSE '555|777' END AS phones, 'Oslo' AS location,
'Go|True' AS skills, 3.5::DOUBLE AS years, CASE c_custkey % 2 WHEN 1 THEN 'Acme' END AS company, CASE c_custkey % 2 WHEN 0 THEN 'plain' END AS raw, CASE c_custkey % 2 WHEN 0 THEN 'mail' ELSE 'contact.emails' END AS email_key, 8 AS n_raw FROM customer""")
def q_applicant_fields(spark, sf_dir):
    c = _customers(spark, sf_dir)
    flat = F.concat(F.lit('{"candidate_id":'), "k", F.lit(',"candidateName":"'), "c_name", F.lit('","mail":["a'), "k", F.lit('@x.org",{"email":"b@x.org"},null,""],"phone":"555","location":{"name":"Oslo"},"skills":["Go",true],"experience_years":"3.5","experience":"plain","education":[]}'))
    deep = F.concat(F.lit('{"candidate":{"id":"N'), "k", F.lit('"},"profile":{"name":"'), "c_name", F.lit('","location":"","skills":[{"name":"Go"},{"label":true}],"years_experience":3.5},"contact":{"emails":[{"value":"a'), "k", F.lit('@x.org"},"b@x.org"],"phones":[{"phone":"555"},777]},"address":{"formatted":"Oslo"},"employment_history":[{"company":"Acme"}],"education_history":[]}'))
    deep = F.replace(deep, F.lit('"location":"",'), F.lit(""))
    out = nested.from_variants(c.select(F.col("k").alias("record_idx"), F.lit("x").alias("uri"), F.try_parse_json(F.when(F.col("k") % 2 == 0, flat).otherwise(deep)).alias("v")))
    key = F.get(F.filter("raw_values", lambda r: r["field_name"] == "emails"), 0)["source_key"]
    return out.select(
        F.col("record_idx").alias("k"), "external_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "location", F.array_join("skills", "|").alias("skills"), F.col("years_experience").alias("years"),
        _get("experience", 0, "company").alias("company"), _get("experience", 0, "raw").alias("raw"), key.alias("email_key"), (F.size("raw_values") - 1).alias("n_raw"),
    )


def _write_each(df: DataFrame, key: str, value: Column, path: str) -> None:
    df.select(F.col(key).cast("string").alias("key"), value.alias("value")).repartition(F.col("key")).write.partitionBy("key").text(path)


@query("""SELECT n_name AS full_name, 'Head of ' || n_name AS headline, 'https://linkedin.com/in/n' || n_nationkey AS external_id, 'Go' AS skill, 25 AS n_records FROM nation""")
def q_profiles_folder(spark, sf_dir):
    """One profile a file; every file is a record of its own."""
    path = folder(spark, "profiles")
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('{"linkedin_profile":{"fullName":"'), "n_name", F.lit('","headline":"Head of '), "n_name", F.lit('","linkedin_url":"https://linkedin.com/in/n'), "n_nationkey", F.lit('","skill_names":["Go"]}}'))
    _write_each(n, "n_nationkey", text, path)
    out = append(split_valid(nested.profiles(spark, path))[0])
    total = out.agg(F.count_distinct("record_idx").cast("int").alias("n_records"))
    return out.select("full_name", "headline", "external_id", F.get("skills", 0).alias("skill")).crossJoin(F.broadcast(total))


@query("""SELECT 'A' || n_nationkey AS external_id, count(*) OVER () AS n FROM nation UNION ALL SELECT 'B' || n_nationkey, count(*) OVER () FROM nation""")
def q_applicants_folder(spark, sf_dir):
    """Two applicants a file; positions in a file do not repeat across files."""
    path = folder(spark, "applicants")
    n = table(spark, sf_dir, "nation")
    _write_each(n, "n_nationkey", F.concat(F.lit('{"candidates":[{"id":"A'), "n_nationkey", F.lit('"},{"id":"B'), "n_nationkey", F.lit('"}]}')), path)
    out = append(split_valid(nested.applicants(spark, path))[0]).withColumn("half", F.left("external_id", F.lit(1)))
    return out.select("external_id", F.size(F.collect_set("record_idx").over(Window.partitionBy("half"))).cast("long").alias("n"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_name END AS full_name, CASE c_custkey % 3 WHEN 1 THEN 'Lead' END AS headline, CASE c_custkey % 3 WHEN 0 THEN 'https://www.linkedin.com/in/c' || c_custkey END AS link,
CASE c_custkey % 3 WHEN 2 THEN 'no profile field' END AS error, 'linkedin' AS kind FROM customer""")
def q_linked_profiles(spark, sf_dir):
    c = _customers(spark, sf_dir)
    some = F.concat(F.lit('{"name":"'), "c_name", F.lit('","public_profile_url":"https://www.linkedin.com/in/c'), "k", F.lit('"}'))
    text = F.when(F.col("k") % 3 == 0, some).when(F.col("k") % 3 == 1, '{"summary":"Lead"}').otherwise('{"other":1}')
    out = nested.linked_profiles(c.select(F.col("k").alias("record_idx"), F.lit("f").alias("uri"), F.try_parse_json(text).alias("v")))
    return out.select(F.col("record_idx").alias("k"), "full_name", "headline", F.get("links", 0).alias("link"), "error", F.col("source.source_type").alias("kind"))


@query("""SELECT c_custkey AS k, 'dev' || c_custkey AS external_id, CASE c_custkey % 2 WHEN 0 THEN 'https://github.com/own' || c_custkey ELSE 'https://github.com/dev' || c_custkey END AS link, 'Go|Rust' AS skills, 2 AS n_repos, 'f' AS uri, 'username|languages|repositories' AS raw FROM customer""")
def q_exported_profiles(spark, sf_dir):
    c = _customers(spark, sf_dir)
    v = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"login":"dev'), "k", F.lit('","html_url":"https://github.com/own'), "k", F.lit('","languages":["Go"]}'))).otherwise(F.concat(F.lit('{"username":"dev'), "k", F.lit('","languages":["Go","GO"]}')))
    repos = F.try_variant_get(F.try_parse_json(F.lit('[{"name":"a","language":"Rust"},{"name":"b","language":""}]')), "$", "array<variant>")
    out = nested.exported_profiles(c.select(F.col("k").alias("record_idx"), F.lit("f").alias("uri"), F.try_parse_json(v).alias("v"), repos.alias("repos")))
    return out.select(F.col("record_idx").alias("k"), "external_id", F.get("links", 0).alias("link"), F.array_join("skills", "|").alias("skills"), F.size("experience").alias("n_repos"), F.col("source.source_uri").alias("uri"), F.array_join(F.transform("raw_values", lambda r: r["field_name"]), "|").alias("raw"))


def _service(c: DataFrame) -> DataFrame:
    """A profile service's table for customers that 3 divides."""
    v = F.concat(F.lit('{"login":"Dev'), "k", F.lit('","name":"Dev '), "k", F.lit('","blog":"dev'), "k", F.lit('.io","email":"d'), "k", F.lit('@x.org","followers":7}'))
    repos = F.try_variant_get(F.try_parse_json(F.lit('[{"name":"a","language":"Go","stargazers_count":3,"more":1}]')), "$", "array<variant>")
    return c.where("k % 3 = 0").select(_k("Dev").alias("login"), F.try_parse_json(v).alias("v"), repos.alias("repos"))


@query("""SELECT c_custkey AS k, 'Dev' || c_custkey AS external_id, 'https://github.com/DEV' || c_custkey || '/' AS link, 'https://dev' || c_custkey || '.io' AS blog, 'd' || c_custkey || '@x.org' AS email, 8 AS n_keys, '3' AS stars, 'username|github_url|emails|blog|followers|languages|repositories' AS raw FROM customer WHERE c_custkey % 3 = 0""")
def q_fetched_profiles(spark, sf_dir):
    c = _customers(spark, sf_dir)
    found, _ = nested.code_profiles(c.select(F.col("k").alias("record_idx"), _k("https://github.com/DEV", "/").alias("url")), _service(c))
    keys = F.size(F.json_object_keys(F.get("experience", 0)))
    return found.select(F.col("record_idx").alias("k"), "external_id", F.get("links", 0).alias("link"), F.get("links", 1).alias("blog"), F.get("emails", 0).alias("email"), keys.alias("n_keys"), _get("experience", 0, "stargazers_count").alias("stars"), F.array_join(F.transform("raw_values", lambda r: r["field_name"]), "|").alias("raw"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'link must start with http:// or https://' WHEN 1 THEN 'link must use github.com' WHEN 2 THEN 'link must have a user name' WHEN 3 THEN 'link must lead to a user profile' ELSE 'profile not found' END AS warning FROM customer""")
def q_profile_warnings(spark, sf_dir):
    c = _customers(spark, sf_dir)
    urls = F.element_at(F.array(_k("ftp://github.com/a"), _k("https://gitlab.com/a"), F.lit("https://www.github.com//"), _k("https://github.com/orgs/a"), _k("https://github.com/nobody")), (F.col("k") % 5 + 1).cast("int"))
    _, warnings = nested.code_profiles(c.select(F.col("k").alias("record_idx"), urls.alias("url")), _service(c.where("k < 0")))
    return warnings.select(F.col("record_idx").alias("k"), "warning")


@query("""SELECT 'record' AS what, count(*) AS n FROM customer UNION ALL SELECT 'profile', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'warning', count(*) FROM customer WHERE c_custkey % 3 <> 0""")
def q_enriched_profiles(spark, sf_dir):
    """Each customer has its profile link twice and one of another host; a link counts once."""
    c = _customers(spark, sf_dir)
    people = _own(c, links=F.array(_k("https://github.com/dev"), _k("https://GitHub.com/dev", "/"), _k("https://x.org/")))
    both, warnings = enrich.enrich_profiles(people, _service(c))
    rows = both.select(F.when(F.col("source.source_type") == "github", "profile").otherwise("record").alias("what")).union(warnings.select(F.lit("warning")))
    return rows.groupBy("what").agg(F.count(F.lit(1)).alias("n"))


# ---- scalars and rules


@query("""SELECT c_custkey AS k, 'cv' || c_custkey || '.pdf' AS file, '{"a":1,"b":"x' || c_custkey || '"}' AS json, CASE c_custkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'github' WHEN 2 THEN 'linkedin' ELSE 'other' END AS kind, CASE c_custkey % 2 WHEN 0 THEN 'x' END AS text, '415' || c_custkey AS phone FROM customer""")
def q_scalar_keys(spark, sf_dir):
    label = F.element_at(F.array(F.lit("ATS_json"), F.lit("GitHub API"), F.lit("my_linkedin"), F.lit("merge_engine")), (F.col("k") % 4 + 1).cast("int"))
    return _customers(spark, sf_dir).select(
        "k", S.file_key(_k("C:\\up/CV", ".PDF ")).alias("file"), S.json_key(F.concat(F.lit('{"b":"X'), "k", F.lit('","a":1}'))).alias("json"), S.source_type(label).alias("kind"),
        S.none_if_blank(F.when(F.col("k") % 2 == 0, " x ").otherwise("  ")).alias("text"), S.phone_key(_k("(415) ", "x")).alias("phone"),
    )


@query("""SELECT c_custkey AS k, lower(c_mktsegment) || '|acme inc' AS companies FROM customer""")
def q_companies(spark, sf_dir):
    jobs = F.array(F.to_json(F.struct(F.col("seg").alias("company"))), F.lit('{"company":"","employer":"Acme, Inc."}'), F.lit('{"title":"x"}'))
    return _own(_customers(spark, sf_dir), experience=jobs).select(F.col("record_idx").alias("k"), F.array_join(matching.companies(), "|").alias("companies"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 95.0 WHEN 1 THEN 90.0 WHEN 2 THEN 0.0 ELSE 95.0 END::DOUBLE AS score FROM customer""")
def q_initials(spark, sf_dir):
    from mergewell.functions import similarity

    pair = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % 4 + 1).cast("int"))
    return _customers(spark, sf_dir).select("k", similarity.initials_score(pair("sandhya m", "a lovelace", "b lovelace", "lovelace a"), pair("sandhya muruganand", "ada king lovelace", "ada lovelace", "ada lovelace")).alias("score"))


def _triples(spark, sf_dir) -> DataFrame:
    """Three records share an e-mail, two of them a phone, fifty a link."""
    c = _customers(spark, sf_dir)
    three, fifty = F.floor(F.col("k") / 3), F.floor(F.col("k") / 50)
    return _own(c, emails=F.array(F.concat(F.lit("m"), three, F.lit("@x.org"))), phones=F.when(F.col("k") % 3 > 0, F.array(F.concat(F.lit("+9195"), F.lpad(three.cast("string"), 8, "0")))), links=F.array(F.concat(F.lit("https://github.com/g"), fifty), F.concat(F.lit("https://linkedin.com/in/l"), fifty)))


_RULES_SQL = """SELECT a.c_custkey AS left_idx, b.c_custkey AS right_idx, CASE WHEN a.c_custkey // 3 = b.c_custkey // 3 THEN 1 ELSE 3 END AS rule, CASE WHEN a.c_custkey // 3 = b.c_custkey // 3 THEN 1.0 ELSE 0.94 END::DOUBLE AS confidence,
CASE WHEN a.c_custkey // 3 = b.c_custkey // 3 THEN 'Email matched: m' || (a.c_custkey // 3) || '@x.org' ELSE 'GitHub URL matched' END AS reason FROM customer a JOIN customer b ON a.c_custkey > b.c_custkey AND (a.c_custkey // 3 = b.c_custkey // 3 OR a.c_custkey // 50 = b.c_custkey // 50)"""


@query(f"""WITH p AS ({_RULES_SQL}) SELECT * FROM p WHERE right_idx = left_idx // 50 * 50 OR right_idx = left_idx // 3 * 3 OR (left_idx % 3 = 2 AND right_idx = left_idx - 1)""")
def q_match_first_rule_3(spark, sf_dir):
    """Each record with the first one of each of its keys, by the first rule that holds for the two."""
    found = matching.matches(_triples(spark, sf_dir), fuzzy=False)
    return found.select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "rule", "confidence", "reason")


@query(_RULES_SQL)
def q_match_complete(spark, sf_dir):
    found = matching.matches(_triples(spark, sf_dir), fuzzy=False, complete=True)
    return found.select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "rule", "confidence", "reason")


@query("""SELECT c_custkey * 2 + 1 AS left_idx, c_custkey * 2 AS right_idx, 9 AS rule, 0.96::DOUBLE AS confidence FROM customer""")
def q_match_linkedin(spark, sf_dir):
    """By a link of another spelling, by the source's own address, and by a list among raw values."""
    c = _customers(spark, sf_dir)
    link = _k("https://www.LinkedIn.com/in/p", "/")
    a = _own(c, record_idx=F.col("k") * 2, links=F.array(link))
    b = _own(c, record_idx=F.col("k") * 2 + 1, source=source("csv", "x", F.col("k"), F.when(F.col("k") % 2 == 0, _k("http://linkedin.com/in/p", "?x=1")), AT), raw_values=F.array(F.struct(F.lit("profile_links").alias("field_name"), F.lit("l").alias("source_key"), F.when(F.col("k") % 2 == 1, F.concat(F.lit('["https://x.org","https://linkedin.com/in/p'), "k", F.lit('"]'))).otherwise("x").alias("value"))))
    return matching.matches(a.union(b), fuzzy=False).select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "rule", "confidence")


def _fused(spark, sf_dir) -> DataFrame:
    """Of each customer three records: the third shares an e-mail with the first and a phone with the second."""
    c = _customers(spark, sf_dir)
    mail, phone = F.array(_k("m", "@x.org")), F.array(F.concat(F.lit("+919"), F.lpad(F.col("k").cast("string"), 9, "0")))
    rows = [_own(c, record_idx=F.col("k") * 4, emails=mail, full_name=F.lit("A")), _own(c, "json", "ats_json", record_idx=F.col("k") * 4 + 1, phones=phone, full_name=F.lit("B")), _own(c, "resume", "resume", record_idx=F.col("k") * 4 + 2, emails=mail, phones=phone, full_name=F.lit("C")), _own(c, record_idx=F.col("k") * 4 + 3, emails=mail)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("""SELECT c_custkey * 4 + 2 AS left_idx, c_custkey * 4 AS right_idx, 1.0::DOUBLE AS confidence, 'Email matched: m' || c_custkey || '@x.org' AS reason, 'C' AS left_candidate, 'csv' AS right_source, c_custkey * 4 AS cluster_id FROM customer
UNION ALL SELECT c_custkey * 4 + 2, c_custkey * 4 + 1, 0.98, 'Phone number matched', 'C', 'json', c_custkey * 4 FROM customer
UNION ALL SELECT c_custkey * 4 + 3, c_custkey * 4 + 2, 1.0, 'Email matched: m' || c_custkey || '@x.org', NULL, 'resume', c_custkey * 4 FROM customer""")
def q_match_events(spark, sf_dir):
    """An event for each group that a record joins: the third record fuses two."""
    rows = _fused(spark, sf_dir)
    found = matching.matches(rows, fuzzy=False, complete=True)
    out = clustering.described(clustering.events(found), rows, clustering.components(rows, found))
    return out.select(F.col("left").alias("left_idx"), F.col("right").alias("right_idx"), "confidence", "reason", "left_candidate", "right_source", "cluster_id")


# ---- merging, provenance, canonical form


@query("""SELECT c_custkey AS k, '{"company":"Acme","title":"' || c_custkey || '"}|{"company":"Beta"}' AS experience, 3 AS n_raw, 'other' AS kind, 'merge_engine' AS name, 'J' || c_custkey AS record_id, 'ats_json>recruiter_csv' AS lineage FROM customer""")
def q_merge_objects(spark, sf_dir):
    c = _customers(spark, sf_dir)
    raw = lambda *names: F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(n).alias("source_key"), F.lit("x").alias("value")) for n in names])
    a = _own(c, record_idx=F.col("k") * 2, external_id=_k("C"), experience=F.array(F.concat(F.lit('{"title":"'), "k", F.lit('","company":"ACME"}')), F.lit('{"company":"Beta"}')), raw_values=raw("emails", "emails"))
    b = _own(c, "json", "ats_json", record_idx=F.col("k") * 2 + 1, external_id=_k("J"), experience=F.array(F.concat(F.lit('{"company":"Acme","title":"'), "k", F.lit('"}'))), raw_values=raw("emails", "phones"))
    rows = a.union(b)
    clusters = rows.select("record_idx", F.floor(F.col("record_idx") / 2).alias("cluster_id"))
    m = merging.merge(rows, clusters, PRIORITIES)
    return m.select(
        F.col("cluster_id").alias("k"), F.array_join("experience", "|").alias("experience"), F.size("raw_values").alias("n_raw"), F.col("source.source_type").alias("kind"), F.col("source.source_name").alias("name"), F.col("source.source_record_id").alias("record_id"),
        F.array_join(F.transform("merged_from", lambda x: x["label"]), ">").alias("lineage"),
    )


_PROVENANCE = f"""WITH {SQL}, s AS (SELECT k, max(CASE WHEN kind IN ('json', 'github') THEN 1 ELSE 0 END) AS ids, max(url) AS url, max(years) AS years FROM r GROUP BY k), p AS (
SELECT k, label AS source, kind, unnest(CASE kind WHEN 'csv' THEN ['full_name','emails','phones','skills'] WHEN 'json' THEN ['external_id','emails','headline'] WHEN 'github' THEN ['external_id','skills'] ELSE ['phones','resume_summary'] END) AS field,
  unnest(CASE kind WHEN 'csv' THEN ['full_name','emails','phones','skills'] WHEN 'json' THEN ['candidate_id','emails','headline'] WHEN 'github' THEN ['username','languages'] ELSE ['phones','resume_summary'] END) AS source_key FROM r
UNION ALL SELECT k, 'merge_engine', 'other', 'external_id', NULL FROM s WHERE ids = 0
UNION ALL SELECT k, 'merge_engine', 'other', unnest(['location', 'experience']), NULL FROM s
UNION ALL SELECT k, 'merge_engine', 'other', 'links', NULL FROM s WHERE url IS NOT NULL
UNION ALL SELECT k, 'merge_engine', 'other', 'years_experience', NULL FROM s WHERE years IS NOT NULL)"""


@query(_PROVENANCE + """ SELECT k * 4 AS cluster_id, field, source, source_key, CASE WHEN field IN ('external_id','full_name','location','headline','years_experience','resume_summary') THEN 'source_priority' ELSE 'union_deduplicate' END AS merge_method, CASE WHEN field = 'emails' THEN 'own' END AS own, TIMESTAMP '2024-01-01 00:00:00' AS observed FROM p""")
def q_provenance_methods(spark, sf_dir):
    p = scoring.provenance_rows(_merged(spark, sf_dir)).select("cluster_id", "field", "source", "source_key", "merge_method", "observed")
    mine = scoring.provenance_rows(_merged(spark, sf_dir), merge_methods={"emails": "own"}, timestamps=False).where("merge_method = 'own' and observed is null").groupBy("cluster_id", "field").agg(F.first("merge_method").alias("own"))
    return p.join(mine, ["cluster_id", "field"], "left")


@query(_PROVENANCE + " SELECT k * 4 AS cluster_id, kind AS source, field, count(*) AS n FROM p GROUP BY ALL")
def q_canonical_provenance(spark, sf_dir):
    return output.canonical(_merged(spark, sf_dir)).select("cluster_id", F.explode("provenance").alias("p")).groupBy("cluster_id", "p.source", "p.field").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'C' || c_custkey WHEN 1 THEN 'a@x.org' WHEN 2 THEN c_name ELSE 'unknown' END AS candidate_id, CASE c_custkey % 4 WHEN 3 THEN 'Unknown Candidate' ELSE c_name END AS full_name, 'Oslo' AS location,
'MIT|BS' AS education, 'one|d1|Go,Rust/two|r2|Go' AS projects, 'sum' AS resume_summary, CASE c_custkey % 4 WHEN 3 THEN 'link without http' ELSE '' END AS errors FROM customer""")
def q_canonical_fields(spark, sf_dir):
    c = _customers(spark, sf_dir)
    m = F.col("k") % 4
    rows = _own(
        c, external_id=F.when(m == 0, _k("C")), emails=F.when(m == 1, F.array(F.lit("a@x.org"))).otherwise(F.array()), full_name=F.when(m < 3, F.col("c_name")), location=F.lit("Oslo"), resume_summary=F.lit("sum"), links=F.when(m == 3, F.array(F.lit("ftp://x"))).otherwise(F.array(F.lit("http://x.org"))),
        education=F.array(F.lit('{"school":"MIT","degree":"BS"}'), F.lit('{"degree":"none"}')), projects=F.array(F.lit('{"project":"one","description":"d1","technologies":["Go","","Rust"]}'), F.lit('{"title":"two","raw":"r2","technologies":"Go"}'), F.lit('{"raw":"nameless"}')),
    )
    merged = scoring.score(merging.merge(rows, rows.select("record_idx", F.col("record_idx").alias("cluster_id"))))
    x = output.canonical(merged)
    projects = F.array_join(F.transform("projects", lambda p: F.concat_ws("|", p["name"], p["description"], F.array_join(p["technologies"], ","))), "/")
    education = F.array_join(F.transform("education", lambda e: F.concat_ws("|", e["institution"], e["degree"])), "/")
    return x.select(F.col("cluster_id").alias("k"), "candidate_id", "full_name", F.col("location.raw").alias("location"), education.alias("education"), projects.alias("projects"), "resume_summary", F.array_join("errors", ",").alias("errors"))


# ---- output


@query("""SELECT c_custkey AS k, '{"Mail":["a' || c_custkey || '@x.org"],"phones":["+919' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '"],"skills":["Python","Go"],"years_experience":2.5,"location":{"raw":"O\\"slo"},"links":[{"type":"portfolio","url":"http://x.org"}]}' AS output FROM customer""")
def q_project_normalized(spark, sf_dir):
    c = _customers(spark, sf_dir)
    rows = _own(c, emails=F.array(_k(" A", "@X.org"), F.lit("bad")), phones=F.array(F.concat(F.lit("+91 9"), F.lpad(F.col("k").cast("string"), 9, "0")), F.lit("12")), skills=F.array(F.lit("py"), F.lit("Go"), F.lit("PYTHON")), years_experience=F.lit(2.5), location=F.lit('O"slo'), links=F.array(F.lit("http://x.org")), headline=F.lit(None))
    x = output.canonical(scoring.score(merging.merge(rows, rows.select("record_idx", F.col("record_idx").alias("cluster_id")))))
    names = ("emails", "phones", "skills", "years_experience", "location", "links", "headline")
    config = {"output_fields": [{"name": n} for n in names], "field_renaming": {"emails": "Mail"}, "apply_normalization": True, "missing_value_strategy": "omit"}
    return output.project(x, config).select(F.col("cluster_id").alias("k"), "output")


@query("""SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'b:missing' WHEN 2 THEN 'c:extra_forbidden' WHEN 3 THEN '$:invalid_root_type' WHEN 4 THEN '$:not_json_serializable' ELSE 'a:required_missing' END AS errors FROM customer""")
def q_validate_shapes(spark, sf_dir):
    texts = ('{"a":1,"b":2}', '{"a":1}', '{"a":1,"b":2,"c":3}', "[1]", '{"a":', '{"a":"","b":2}')
    out = _customers(spark, sf_dir).select(F.col("k").alias("cluster_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 6 + 1).cast("int")).alias("output"))
    checked = output.validate(out, {"output_fields": [{"name": "a", "required": True}, {"name": "b"}]})
    return checked.select(F.col("cluster_id").alias("k"), F.array_join(F.transform("validation", lambda e: F.concat(e["field"], F.lit(":"), e["error_type"])), ",").alias("errors"))


@query(f"WITH {SQL}, s AS (SELECT k, max(headline) AS h FROM r GROUP BY k) SELECT count(*) AS errors FROM s WHERE h IS NULL")
def q_error_count(spark, sf_dir):
    config = {"output_fields": [{"name": "full_name", "required": True}, {"name": "headline", "required": True}]}
    return output.error_count(output.validate(output.project(output.canonical(_merged(spark, sf_dir)), config), config))


@query(f"WITH {SQL} SELECT k * 4 AS cluster_id, full_name AS name, email, c_mktsegment AS company, 'valid' AS status, row_number() OVER (ORDER BY k) AS place FROM r JOIN customer ON c_custkey = k WHERE kind = 'csv' AND lower(full_name) LIKE '%grace%'")
def q_dashboard_rows(spark, sf_dir):
    """All columns but the percentage, and the place among equals: all scores are set equal."""
    x = output.canonical(_merged(spark, sf_dir)).withColumn("overall_confidence", F.lit(0.5))
    rows = output.dashboard(x, "gRACE").withColumn("at", F.monotonically_increasing_id())
    return rows.where("confidence_pct = 50.0").select("cluster_id", "name", "email", "company", "status", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@query(f"WITH {SQL}, s AS (SELECT k, string_agg(CASE kind WHEN 'csv' THEN 'Recruiter CSV' WHEN 'json' THEN 'ATS JSON' WHEN 'github' THEN 'GitHub' ELSE 'Resume' END, '|' ORDER BY CASE kind WHEN 'github' THEN 1 WHEN 'resume' THEN 2 WHEN 'json' THEN 3 ELSE 4 END) AS shown FROM r GROUP BY k) SELECT k * 4 AS cluster_id, shown FROM s")
def q_source_labels(spark, sf_dir):
    return output.contributing(_merged(spark, sf_dir)).select("cluster_id", F.array_join(output.shown_sources(F.col("sources")), "|").alias("shown"))


@query(f"""WITH {SQL} SELECT k * 4 AS cluster_id, 'Email' AS label, email AS value FROM r WHERE kind = 'csv' UNION ALL SELECT k * 4, 'Location', place FROM c UNION ALL SELECT k * 4, 'Engineer', c_mktsegment FROM c
UNION ALL SELECT k * 4, 'Headline', CASE k % 2 WHEN 0 THEN 'Engineer' ELSE '-' END FROM c UNION ALL SELECT k * 4, 'full_name', '60%' FROM c""")
def q_details(spark, sf_dir):
    rows = output.details(output.canonical(_merged(spark, sf_dir)))
    return rows.where("label in ('Email', 'Location', 'Headline') or section = 'experience' or section = 'confidence' and label = 'full_name'").select("cluster_id", "label", "value")


# ---- a model's answers, sinks


def _answered(spark, sf_dir) -> DataFrame:
    c = _customers(spark, sf_dir)
    rows = _own(c, headline=F.when(F.col("k") % 2 == 0, "own"), skills=F.array(F.lit("Go")), projects=F.array(F.lit('{"name":"a","x":1}')), raw_payload=F.lit('{"k":1}'))
    answer = F.lit('{"candidate_record":{"headline":"given","skills":["go","Rust"],"projects":[{"x":1,"name":"A"},{"name":"b"}],"raw_payload":"no"},"ai_summary":"sums up","strengths":["s1","s2","s1"],"suggested_roles":[]}')
    answers = c.where("k % 3 < 2").select(F.col("k").alias("record_idx"), F.when(F.col("k") % 3 == 0, answer).otherwise("[1]").alias("payload"))
    return enrich.add_insights(rows, answers)


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'given' END AS headline, CASE c_custkey % 3 WHEN 0 THEN 'Go|Rust' ELSE 'Go' END AS skills, CASE c_custkey % 3 WHEN 0 THEN '{"name":"a","x":1}|{"name":"b"}' ELSE '{"name":"a","x":1}' END AS projects,
CASE c_custkey % 3 WHEN 0 THEN 'available' ELSE 'unavailable' END AS status, '1' AS payload FROM customer""")
def q_model_answers(spark, sf_dir):
    return _answered(spark, sf_dir).select(F.col("record_idx").alias("k"), "headline", F.array_join("skills", "|").alias("skills"), F.array_join("projects", "|").alias("projects"), F.get_json_object("raw_payload", "$.ai_enrichment.status").alias("status"), F.get_json_object("raw_payload", "$.k").alias("payload"))


def _insights(spark, sf_dir) -> DataFrame:
    rows = _answered(spark, sf_dir)
    return enrich.insights(merging.merge(rows, rows.select("record_idx", F.col("record_idx").alias("cluster_id"))))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'sums up' END AS ai_summary, CASE c_custkey % 3 WHEN 0 THEN 's1|s2' ELSE '' END AS strengths, 0 AS roles FROM customer""")
def q_insights(spark, sf_dir):
    return _insights(spark, sf_dir).select(F.col("cluster_id").alias("k"), "ai_summary", F.array_join("strengths", "|").alias("strengths"), F.size("suggested_roles").alias("roles"))


@query("""SELECT c_custkey AS k, section, value FROM customer, (VALUES (0, 'AI Summary', 'sums up'), (0, 'Strengths', 's1'), (0, 'Strengths', 's2'), (1, 'AI Insights', 'No AI insights available.'), (2, 'AI Insights', 'No AI insights available.')) t(m, section, value) WHERE c_custkey % 3 = m""")
def q_insight_rows(spark, sf_dir):
    return enrich.insight_rows(_insights(spark, sf_dir)).select(F.col("cluster_id").alias("k"), "section", "value")


@query("SELECT count(*) > 0 AS unavailable FROM customer WHERE c_custkey % 3 > 0")
def q_model_unavailable(spark, sf_dir):
    return enrich.unavailable(_answered(spark, sf_dir))


def _written(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _own(_customers(spark, sf_dir), external_id=_k("C"), full_name=F.col("c_name"))
    x = output.canonical(scoring.score(merging.merge(rows, rows.select("record_idx", F.col("record_idx").alias("cluster_id")))))
    return x, output.project(x, {"output_fields": [{"name": "candidate_id"}, {"name": "full_name"}]})


@query("""SELECT '{"candidate_id":"C' || c_custkey || '","full_name":"' || c_name || '"}' AS output FROM customer""")
def q_written_json(spark, sf_dir):
    _, projected = _written(spark, sf_dir)
    path = folder(spark, "written")
    sinks.write_json(projected, path)
    return sinks.read_json(spark, path)


@query("""SELECT 'C7.json' AS file_name, '{"candidate_id":"C7","full_name":"' || c_name || '"}' AS content FROM customer WHERE c_custkey = 7""")
def q_one_json(spark, sf_dir):
    x, projected = _written(spark, sf_dir)
    return sinks.one(x, projected, 7).select("file_name", F.to_json(F.try_parse_json("content")).alias("content"))
