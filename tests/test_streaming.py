from mergewell.streaming.ingest import ingest_folder


def test_files_are_taken_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: ingest_folder(spark, str(inbox), ["candidate_id", "name", "email", "total_experience"], str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    (inbox / "a.csv").write_text("candidate_id,name,email,total_experience\n1,Ada,A@x.com,3\n2,Bob,b@x.com,senior\n")
    run()
    (inbox / "b.csv").write_text("candidate_id,name,email,total_experience\n3,Cy,c@x.com,\n")
    run()
    run()
    assert {r.external_id: r.emails for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1": ["a@x.com"], "3": ["c@x.com"]}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
