"""Records of several sources derived from the driver's ``customer`` table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.sources.records import as_records, source

FIRST = "Ada,Grace,Alan,Edsger,Barbara"
SKILLS = "Py|SQL,js|Docker,node-js|python 3,Spark|SPARK|Py"
PLACES = "Berlin; Germany,London; England; UK,Pune; India,San Francisco; CA,Paris"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session names for checkpoints; a local session may name none."""
    import tempfile
    import uuid

    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="mergewell-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer by CSV, each second by JSON, each fifth by a code host, each seventh by résumé."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment")
    pick = lambda text, n: F.split_part(F.lit(text), F.lit(","), (F.col("k") % n + 1).cast("int"))
    first, last = pick(FIRST, 5), F.concat(F.lit("Lovelace"), F.col("k"))
    mail = F.concat(first, F.lit("."), last, F.lit("@Example.com"))
    number = F.lpad(F.col("k").cast("string"), 9, "0")
    skills = F.split(pick(SKILLS, 4), r"\|")
    place = F.replace(pick(PLACES, 5), F.lit(";"), F.lit(","))
    job = F.to_json(F.struct(F.col("c_mktsegment").alias("company"), F.lit("Engineer").alias("title")))
    raw = lambda label, *names: F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(n).alias("source_key"), F.lit("x").alias("value")) for n in names])
    ident = lambda p: F.concat(F.lit(p), F.col("k"))
    kinds = {
        "csv": (0, 1, "recruiter_csv", dict(external_id=ident("C"), full_name=F.concat(first, F.lit(" "), last), emails=F.array(F.concat(F.lit(" "), mail)), phones=F.array(F.concat(F.lit("+91 9"), number)), skills=skills, location=place, experience=F.array(job), years_experience=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), raw_values=raw("csv", "full_name", "emails", "phones", "skills"))),
        "json": (1, 2, "ats_json", dict(external_id=ident("J"), full_name=F.concat(first, F.lit(" "), last), emails=F.array(F.lower(mail)), skills=F.array(F.lit("Kafka"), F.lit("py")), headline=F.lit("Engineer"), raw_values=raw("json", "candidate_id", "emails", "headline"))),
        "github": (2, 5, "github_profile", dict(external_id=ident("dev"), links=F.array(F.concat(F.lit("https://www.GitHub.com/dev"), F.col("k"), F.lit("/"))), skills=F.array(F.lit("Python"), F.lit("Rust")), raw_values=raw("github", "username", "languages"))),
        "resume": (3, 7, "resume", dict(external_id=ident("R"), phones=F.array(F.concat(F.lit("+919"), number)), resume_file=F.concat(F.lit("cv/Person"), F.col("k"), F.lit(".PDF")), resume_summary=F.lit("Builds things"), raw_values=raw("resume", "phones", "resume_summary"))),
    }
    out = None
    for kind, (ordinal, every, name, columns) in kinds.items():
        rows = c.where(F.col("k") % every == 0)
        if kind == "csv":
            columns["links"] = F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("https://github.com/dev"), F.col("k")))).otherwise(F.array())
        frame = as_records(rows, record_idx=F.col("k") * 4 + ordinal, source=source(kind, name, columns["external_id"], F.lit(None).cast("string"), "2024-01-01 00:00:00"), raw_payload=F.to_json(F.struct("k")), **columns)
        out = frame if out is None else out.unionByName(frame)
    return out


#: The same sources as rows of plain columns, for checks in SQL.
SQL = f"""
c AS (SELECT c_custkey AS k, c_acctbal, c_mktsegment,
  split_part('{FIRST}', ',', CAST(c_custkey % 5 AS INT) + 1) AS fn, 'Lovelace' || c_custkey AS ln,
  split_part('{SKILLS}', ',', CAST(c_custkey % 4 AS INT) + 1) AS sk,
  replace(split_part('{PLACES}', ',', CAST(c_custkey % 5 AS INT) + 1), ';', ',') AS place,
  lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS num FROM customer),
r AS (
  SELECT k * 4 AS record_idx, k, 'csv' AS kind, 'recruiter_csv' AS label, 'C' || k AS external_id, fn || ' ' || ln AS full_name, lower(fn || '.' || ln || '@Example.com') AS email, '+919' || num AS phone, CASE WHEN k % 5 = 0 THEN 'github.com/dev' || k END AS url, sk AS skills, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS years, CAST(NULL AS VARCHAR) AS headline FROM c
  UNION ALL SELECT k * 4 + 1, k, 'json', 'ats_json', 'J' || k, fn || ' ' || ln, lower(fn || '.' || ln || '@Example.com'), NULL, NULL, 'Kafka|py', NULL, 'Engineer' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k * 4 + 2, k, 'github', 'github_profile', 'dev' || k, NULL, NULL, NULL, 'github.com/dev' || k, 'Python|Rust', NULL, NULL FROM c WHERE k % 5 = 0
  UNION ALL SELECT k * 4 + 3, k, 'resume', 'resume', 'R' || k, NULL, NULL, '+919' || num, NULL, '', NULL, NULL FROM c WHERE k % 7 = 0)
"""
