"""Résumés are read once, however often the stages behind them name them."""

from mergewell.operators import enrich
from tests.test_records import rec


def test_extraction_stands_in_no_later_plan(spark):
    people = rec(spark, {"external_id": "C1", "full_name": "Ada King", "emails": ["ada@x.org"]})
    docs = spark.createDataFrame([(0, "/cv/a.pdf", "ada@x.org\nSummary\nby mail"), (1, "/cv/b.pdf", " ")], "record_idx long, path string, text string")
    both, failures = enrich.add_resumes(people, docs)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (both, failures)]
    assert not any("by mail" in p or "regexp_extract_all" in p for p in plans) and max(map(len, plans)) < 60_000
    told = both.where("source.source_type = 'resume'").selectExpr("get_json_object(raw_payload, '$.matched_candidate.external_id') AS c").collect()
    assert [r.c for r in told] == ["C1"] and [r.resume_file for r in failures.collect()] == ["b.pdf"]
