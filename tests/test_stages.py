"""Optional stages, events against a replay, and the queries on people against their SQL."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from mergewell import catalog_people
from mergewell.operators import clustering, enrich, extract
from mergewell.plans.run import run
from mergewell.sources import nested
from mergewell.sources.records import SourceError, append, as_records, source
from tests.test_entry import DATA, con, rows_of  # noqa: F401

CHEAP = [
    "q_resume_fields", "q_resume_entries", "q_delimited_rows", "q_applicant_fields", "q_linked_profiles", "q_exported_profiles", "q_fetched_profiles", "q_profile_warnings", "q_scalar_keys", "q_companies",
    "q_initials", "q_match_first_rule_3", "q_match_complete", "q_match_linkedin", "q_match_events", "q_merge_objects", "q_canonical_fields", "q_project_normalized", "q_validate_shapes", "q_model_answers", "q_insights", "q_insight_rows",
]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, con, name):  # noqa: F811
    got, want = catalog_people.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog_people.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def replay(matches):
    """Records one by one: each fuses the groups that it matches, with an event for each group."""
    groups, events = [], set()
    for left in sorted({x for m in matches for x in m[:2]}):
        hit = []
        for g in groups:
            mine = [(c, r) for (l, r, c) in matches if l == left and r in g]
            if mine:
                c, r = max(mine)
                hit.append(g)
                events.add((left, r, c))
        groups = [g for g in groups if g not in hit] + [{left}.union(*hit)]
    return events


def test_events_equal_a_replay(spark):
    rng = random.Random(41)
    rows = sorted({(a, b): rng.choice([0.9, 0.94, 0.98, 1.0]) for a, b in ((rng.randrange(1, 120), rng.randrange(120)) for _ in range(260)) if a > b}.items())
    matches = [(a, b, c) for (a, b), c in rows]
    df = spark.createDataFrame([(a, b, 1, c, "x") for a, b, c in matches], "left long, right long, rule int, confidence double, reason string")
    assert {(r.left, r.right, r.confidence) for r in clustering.events(df).collect()} == replay(matches)
    assert clustering.events(df.limit(0)).count() == 0


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def people(spark, rows):
    df = spark.createDataFrame(rows, "i long, name string, email string, file string, link string")
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array())
    return as_records(df, record_idx=F.col("i"), source=source("csv", "recruiter_csv", F.col("i"), F.lit(None).cast("string"), "2024-01-01 00:00:00"), external_id=F.concat(F.lit("C"), "i"), full_name=F.col("name"), emails=some("email"), resume_file=F.col("file"), links=some("link"))


def test_documents_fail_one_by_one(spark):
    files = spark.createDataFrame([("a/cv.docx", docx("Ada Lovelace", " ", "x@y.org")), ("b.docx", b"broken"), ("c.PDF", b"%PDF"), ("d.txt", b"x"), ("noend", b"x")], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in extract.document_text(files).collect()}
    assert got["a/cv.docx"] == ("Ada Lovelace\nx@y.org", None)
    assert all(got[p][0] is None and got[p][1] for p in ("b.docx", "c.PDF", "d.txt", "noend"))
    read = {r.path: r.text for r in extract.document_text(files, pdf=lambda b: "PDF " + b.decode()).collect()}
    assert read["c.PDF"] == "PDF %PDF"
    docs = extract.document_text(files).withColumn("record_idx", F.monotonically_increasing_id())
    both, failures = enrich.add_resumes(people(spark, [(0, "Ada", "x@y.org", "up/B.docx", None)]), docs)
    assert {(r.resume_file, r.candidate) for r in failures.collect()} == {("b.docx", "Ada"), ("c.PDF", None), ("d.txt", None), ("noend", None)}
    told = both.where("source.source_type = 'resume'").collect()
    assert len(told) == 1 and json.loads(told[0].raw_payload)["matched_candidate"]["external_id"] == "C0"


def test_a_client_fetches_each_login_once(spark):
    def fetch(login):
        if login == "gone":
            raise ValueError("not there")
        return {"login": login, "name": login.title()}, [{"name": "r", "language": "Go"}]

    rows = [(0, "A", None, None, "https://github.com/ada"), (1, "B", None, None, "https://www.github.com/ada/"), (2, "C", None, None, "https://github.com/gone"), (3, "D", None, None, "https://x.org")]
    both, warnings = enrich.enrich_profiles(people(spark, rows), fetch=fetch)
    assert sorted(r.full_name for r in both.collect()) == ["A", "Ada", "Ada", "B", "C", "D"]
    assert [(r.url, r.warning) for r in warnings.collect()] == [("https://github.com/gone", "not there")]


def test_links_of_a_text_area():
    text = " https://github.com/ada \nhttps://GitHub.com/ada/\n\nnot a link\ngithub.com/bob\nhttps://x.org/github"
    assert nested.profile_links(text) == ["https://github.com/ada", "https://github.com/bob"]


def test_client_pages_and_typed_errors(monkeypatch):
    import urllib.error
    import urllib.request

    asked = []

    def urlopen(request, timeout):
        asked.append(request.full_url)
        if "nobody" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 404, "no", {}, None)
        page = int(request.full_url.rsplit("=", 1)[1]) if "repos" in request.full_url else 0
        body = {"login": "a"} if not page else [{"name": f"r{page}"}] * (2 if page == 1 else 1)
        return io.BytesIO(json.dumps(body).encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    profile, repositories = nested.rest_client("http://service", page_size=2)("a")
    assert profile == {"login": "a"} and len(repositories) == 3 and len(asked) == 3
    with pytest.raises(SourceError, match="profile not found"):
        nested.rest_client("http://service")("nobody")


def test_rows_of_an_input_are_numbered_once(spark):
    twice = people(spark, [(0, "A", None, None, None), (0, "B", None, None, None)])
    with pytest.raises(SourceError):
        append(twice)


def test_run_with_all_stages(spark):
    rows = [(0, "Ada Lovelace", "ada@x.org", "cv.pdf", "https://github.com/ada"), (1, "Bob Stone", "bob@x.org", None, None), (2, "Ada Lovelace", "ADA@x.org", None, None)]
    profiles = spark.createDataFrame([("Ada", '{"login":"Ada","email":"ada@x.org"}')], "login string, j string").select("login", F.try_parse_json("j").alias("v"), F.array().cast("array<variant>").alias("repos"))
    resumes = spark.createDataFrame([(0, "cv.pdf", "Ada Lovelace\nada@x.org\nSkills\nPython"), (1, "bad.pdf", None)], "record_idx long, path string, text string")
    answers = spark.createDataFrame([(1, '{"candidate_record":{"headline":"Builder"},"ai_summary":"solid"}')], "record_idx long, payload string")
    config = {"output_fields": [{"name": "full_name", "required": True}, {"name": "headline"}, {"name": "resume_summary"}, {"name": "provenance"}], "use_ai": True}
    result = run(people(spark, rows), config, fuzzy=False, profiles=profiles, resumes=resumes, answers=answers)
    out = {json.loads(r.output)["full_name"]: json.loads(r.output) for r in result.output.collect()}
    assert set(out) == {"Ada Lovelace", "Bob Stone"} and out["Bob Stone"]["headline"] == "Builder" and out["Ada Lovelace"]["provenance"]
    assert result.failures.count() == 1 and result.events().count() == 3


def test_answers_that_do_not_come(spark):
    tried = spark.sparkContext.accumulator(0)

    def complete(text):
        tried.add(1)
        raise OSError("down")

    got = enrich.ask(people(spark, [(0, "A", None, None, None)]), complete, retries=2).collect()
    assert got[0].payload is None and tried.value == 3
