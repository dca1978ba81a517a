import uuid

from tablecraft import session


def test_materialized_table_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    stored = session.materialize(df, "t")
    assert stored.schema == df.schema
    assert sorted(stored.collect()) == sorted(df.collect(), key=lambda r: r.a)
    assert session.scratch_root(spark) in stored.inputFiles()[0].replace("file://", "file:")


def test_scratch_paths_are_unique(spark):
    first, second = (session.scratch_path(spark, "x") for _ in range(2))
    assert first != second
    assert uuid.UUID(first.rsplit("-", 1)[1])
