import json

import pytest
from pyspark.sql import functions as F

from mergewell.operators import clustering, extract, matching, merging, output, scoring
from mergewell.operators.normalize import normalize
from mergewell.plans.run import run
from mergewell.sources import delimited, nested
from mergewell.sources.records import SourceError, append, as_records, source, split_valid


def rec(spark, *rows):
    """Records from dicts; index, kind and label first."""
    out = []
    for i, row in enumerate(rows):
        df = spark.range(1)
        kind = row.pop("kind", "csv")
        cols = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for k, v in row.items()}
        out.append(as_records(df, record_idx=F.lit(i), source=source(kind, row.get("label", kind), F.lit(str(i)), F.lit(None).cast("string"), "2024-01-01"), raw_payload=F.lit("{}"), **{k: v for k, v in cols.items() if k != "label"}))
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    return df


def test_csv_scan(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('candidate_id,name,email,total_experience,skills,current_company,title\n1,Ada,A@x.com,4,"Python,SQL",Acme,Dev\n2,Bob,b@x.com,senior,,,\n3,Cy,c@x.com,-2,,,\n4,Di,d@x.com,,"a, ,b",,\n')
    good, bad = split_valid(delimited.read(spark, str(f)))
    row = good.collect()
    assert len(row) == 1 and bad.count() == 3
    assert (row[0].external_id, row[0].full_name, row[0].emails, row[0].years_experience, row[0].skills) == ("1", "Ada", ["A@x.com"], 4.0, ["Python", "SQL"])
    assert json.loads(row[0].experience[0]) == {"company": "Acme", "title": "Dev"}
    (tmp_path / "b.csv").write_text("notes\nx\n")
    with pytest.raises(SourceError):
        delimited.read(spark, str(tmp_path / "b.csv"))


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"candidates": [{"id": 7, "profile": {"full_name": "Ada", "skills": [{"name": "SQL"}, "Py"]}, "contact": {"emails": [{"email": "a@x.com"}]}, "employment_history": [{"company": "Acme"}], "years_experience": "3"}, 5, {"id": "x", "years_experience": -1}]}))
    good, bad = split_valid(nested.applicants(spark, str(tmp_path / "a.json")))
    row = good.collect()[0]
    assert (row.external_id, row.full_name, row.emails, row.skills, row.years_experience) == ("7", "Ada", ["a@x.com"], ["SQL", "Py"], 3.0)
    assert json.loads(row.experience[0]) == {"company": "Acme"} and bad.count() == 1
    (tmp_path / "l.json").write_text(json.dumps({"profile": {"name": "Ada", "profile_url": "https://linkedin.com/in/a", "skills": [{"name": "SQL"}]}}))
    row = nested.profiles(spark, str(tmp_path / "l.json")).collect()[0]
    assert (row.full_name, row.external_id, row.links, row.error) == ("Ada", "https://linkedin.com/in/a", ["https://linkedin.com/in/a"], None)
    (tmp_path / "g.json").write_text(json.dumps({"profile": {"login": "ada", "languages": ["Go"]}, "repositories": [{"name": "r", "language": "Rust"}]}))
    row = nested.repositories(spark, str(tmp_path / "g.json")).collect()[0]
    assert (row.external_id, row.skills, row.links) == ("ada", ["Go", "Rust"], ["https://github.com/ada"])
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(SourceError):
        nested.applicants(spark, str(tmp_path / "bad.json"))


def test_append_numbers_inputs(spark):
    a, b = rec(spark, {"full_name": "a"}, {"full_name": "b"}), rec(spark, {"full_name": "c"})
    assert {(r.record_idx, r.full_name) for r in append(a, b).collect()} == {(0, "a"), (1, "b"), (2, "c")}


def test_resume_text(spark):
    text = "Ada Lovelace\nLondon, UK\nada@x.com | +1 415 555 2671 | https://github.com/ada.\nSummary\nWrites programs\nSkills:\nPython, SQL\nWork Experience\nAnalyst at Acme - Jan 2020 - Present\nEducation\nMIT, Bachelor of Science, 2019\nProjects\nEngine: computes\nCertifications\n- AWS\n"
    row = extract.resumes(spark.createDataFrame([(0, "cv/Ada.pdf", text)], "record_idx long, path string, text string")).collect()[0]
    assert (row.full_name, row.location, row.emails, row.phones, row.links) == ("Ada Lovelace", "London, UK", ["ada@x.com"], ["+14155552671"], ["https://github.com/ada"])
    assert (row.skills, row.certifications, row.resume_summary) == (["Python", "SQL"], ["AWS"], "Writes programs")
    assert json.loads(row.experience[0])["company"] == "Acme" and json.loads(row.education[0])["institution"] == "MIT" and json.loads(row.projects[0])["name"] == "Engine"


def test_match_merge_and_output(spark):
    rows = rec(
        spark,
        {"kind": "csv", "external_id": "C1", "full_name": "Ada Lovelace", "emails": ["Ada@X.com "], "skills": ["py"], "headline": ""},
        {"kind": "linkedin", "full_name": "Lovelace Ada", "phones": ["+1 415 555 2671"], "headline": "Engineer", "skills": ["Python", "Go"]},
        {"kind": "json", "external_id": "J1", "emails": ["ada@x.com"], "phones": ["(415) 555-2671"]},
        {"kind": "csv", "external_id": "C2", "full_name": "Bob Smith", "emails": ["bob@x.com"]},
    )
    config = {"output_fields": [{"name": "full_name", "required": True}, {"name": "headline"}, {"name": "phones", "required": True}], "field_renaming": {"full_name": "name"}, "source_priorities": {"linkedin": 9}}
    result = run(rows, config)
    assert {r.cluster_id: r.n for r in result.clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()} == {0: 3, 3: 1}
    merged = {r.cluster_id: r for r in result.merged.collect()}
    assert (merged[0].full_name, merged[0].headline, merged[0].skills, merged[0].external_id) == ("Lovelace Ada", "Engineer", ["Python", "Go"], "C1")
    assert tuple(result.report.first()) == (4, 2, 2, 0.5)
    out = {r.cluster_id: r for r in result.output.collect()}
    assert json.loads(out[0].output) == {"name": "Lovelace Ada", "headline": "Engineer", "phones": ["+14155552671"]} and not out[0].validation
    assert json.loads(out[3].output) == {"name": "Bob Smith", "headline": None, "phones": None}
    assert [e.error_type for e in out[3].validation] == ["required_missing"]


def test_name_initials_have_a_direction(spark):
    one = normalize(rec(spark, {"full_name": "Sandhya Muruganand"}, {"full_name": "SANDHYA M"}))
    other = normalize(rec(spark, {"full_name": "SANDHYA M"}, {"full_name": "Sandhya Muruganand"}))
    assert matching.name_matches(one).count() == 1 and matching.name_matches(other).count() == 0


def test_noisy_or_and_overall(spark):
    df = spark.range(1).select(scoring.noisy_or(F.array(F.lit("csv"), F.lit("linkedin"))).alias("a"), scoring.noisy_or(F.array(F.lit("unknown"))).alias("b"))
    assert tuple(df.first()) == (0.96, 0.4)
    rows = rec(spark, {"kind": "csv", "label": "csv", "full_name": "A", "emails": ["a@x.com"]})
    clusters = rows.select("record_idx", F.col("record_idx").alias("cluster_id"))
    got = scoring.score(merging.merge(rows, clusters)).first()
    assert got.field_confidence["emails"] == 0.6 and got.overall_confidence == 0.6


def test_components_of_a_chain(spark):
    rows = spark.range(40).select(F.col("id").alias("record_idx"))
    pairs = spark.range(1, 30).select(F.col("id").alias("left"), (F.col("id") - 1).alias("right"))
    got = {r.record_idx: r.cluster_id for r in clustering.components(rows, pairs).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(40)}


def test_config_errors(tmp_path):
    for bad in ({"output_fields": []}, {"output_fields": [{"name": "a"}], "field_renaming": {"b": "c"}}, {"output_fields": [{"name": "a"}], "missing_value_strategy": "x"}, {"output_fields": [{"name": "a"}], "z": 1}, str(tmp_path / "none.json")):
        with pytest.raises(output.ConfigError):
            output.Config.of(bad)
