"""Papers as columns over the documents."""

from catalog.fixtures import papers

SF = "/root/testdata/sf0.001"


def test_papers_are_not_written_and_unused_parts_not_built(spark):
    whole, narrow = papers(spark, SF), papers(spark, SF, ("Data",))
    assert [f.rsplit("/", 1)[-1] for f in whole.inputFiles()] == ["documents.parquet"]
    plan = narrow.select("_id", "tables.Data")._jdf.queryExecution().optimizedPlan().toString()
    assert "cl_HMD" not in plan and "figCaption" not in plan
    same = ["_id", "tables.tableCaption", "tables.Data"]
    assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, narrow.select(*same).collect()))
