import datetime as dt

import pytest
import retail_data as data
from results import rows
from pyspark.sql import functions as F

from tablecraft import sources
from tablecraft.operators.sql import run_sql
from tablecraft.sources.schemas import RAW_ORDERS, RAW_TABLES


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "seeds" / "raw_orders.csv"
    path.parent.mkdir()
    lines = ["order_id,customer_id,category,amount,region,order_date"]
    lines += ["O1,C1,Home,10.5,EU,2026-03-01", "O2,C2,,20,EU,2026-03-02"]
    path.write_text("\n".join(lines) + "\n")
    return path


def test_csv_with_schema(spark, csv_file):
    df = sources.read_csv(spark, str(csv_file), RAW_ORDERS)
    assert df.schema == RAW_ORDERS
    assert rows(df)[1] == ("O2", "C2", None, 20.0, "EU", dt.date(2026, 3, 2))


def test_csv_inference_widens_integers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,d\n1,x,2024-01-02\n2,y,2024-01-03\n")
    assert dict(sources.read_csv(spark, str(path)).dtypes) == {
        "a": "bigint",
        "b": "string",
        "d": "date",
    }


def test_csv_that_does_not_fit_is_rejected(spark, csv_file):
    csv_file.write_text(csv_file.read_text().replace("10.5", "ten"))
    with pytest.raises(Exception, match="ten|MALFORMED"):
        sources.read_csv(spark, str(csv_file), RAW_ORDERS).collect()
    csv_file.write_text("order_id,category\nO1,Home\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_csv(spark, str(csv_file), RAW_ORDERS).collect()


def test_staged_csv(spark, csv_file, tmp_path):
    staged = sources.stage_files(
        spark, str(csv_file.parent), "*.csv", str(tmp_path / "s"), "csv", RAW_ORDERS
    )
    assert staged.schema == RAW_ORDERS and staged.count() == 2


def test_load_dir(spark, csv_file):
    folder = csv_file.parent
    (folder / "notes.txt").write_text("skipped")
    spark.range(3).toPandas().to_parquet(folder / "numbers.parquet")
    tables = sources.load_dir(spark, str(folder), RAW_TABLES)
    assert list(tables) == ["numbers", "raw_orders"]
    assert tables["numbers"].count() == 3
    assert tables["raw_orders"].schema == RAW_ORDERS


def test_load_dir_of_folders(spark, tmp_path):
    lake = tmp_path / "lake"
    spark.range(6).repartition(3).write.parquet(f"{lake}/orders.parquet")
    spark.range(4).write.option("header", True).csv(f"{lake}/parts.csv")
    spark.range(5).withColumn("d", F.col("id") % 2).write.partitionBy("d").parquet(
        f"{lake}/days.parquet"
    )
    spark.range(3).toPandas().to_parquet(lake / "plain.parquet")
    spark.range(2).write.json(f"{lake}/skipped.json")
    tables = sources.load_dir(spark, str(lake))
    assert {name: table.count() for name, table in tables.items()} == {
        "days": 5, "orders": 6, "parts": 4, "plain": 3,
    }
    assert sources.load_dir(spark, f"file://{lake}/").keys() == tables.keys()


def test_load_missing_dir(spark, tmp_path):
    assert sources.load_dir(spark, str(tmp_path / "absent")) == {}


def test_stage_files_reads_the_tree(spark, tmp_path):
    for folder in ("a", "b/c"):
        target = tmp_path / "lake" / folder
        target.mkdir(parents=True)
        spark.range(2).toPandas().to_parquet(target / "events.parquet")
    spark.range(9).toPandas().to_parquet(tmp_path / "lake" / "other.parquet")
    staged = sources.stage_files(
        spark, str(tmp_path / "lake"), "ev*.parquet", str(tmp_path / "staging")
    )
    assert staged.count() == 4


def test_dispositions(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write_table(spark.range(3), path, "WRITE_EMPTY")
    with pytest.raises(Exception, match="already exists"):
        sources.write_table(spark.range(3), path, "WRITE_EMPTY")
    sources.write_table(spark.range(2), path, "WRITE_APPEND")
    assert spark.read.parquet(path).count() == 5
    sources.write_table(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError, match="WRITE_SOMETIMES"):
        sources.write_table(spark.range(1), path, "WRITE_SOMETIMES")


def test_partitioned_rerun_replaces_its_own_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([(1, "a"), (2, "b")], "x int, d string")
    sources.write_table(both, path, partition_by=["d"])
    again = spark.createDataFrame([(9, "b")], "x int, d string")
    sources.write_table(again, path, partition_by=["d"], replace_partitions_only=True)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (9, "b")]


def test_extract_and_discard(spark, tmp_path):
    orders = data.orders(spark)
    stored = sources.extract(orders, str(tmp_path / "extract"))
    assert rows(stored) == rows(orders)
    sources.discard(orders)


def test_model_path():
    assert sources.model_path("s3://b/models/", "churn", "r1") == "s3://b/models/churn/r1"


def test_run_sql_binds_tables_and_values(spark, tmp_path):
    numbers = spark.createDataFrame([(1, 100), (2, 200)], "id bigint, value bigint")
    doubled = run_sql(
        spark,
        "SELECT id, value * 2 AS doubled FROM {numbers} WHERE id >= :low ORDER BY id",
        tables={"numbers": numbers},
        args={"low": 1},
    )
    assert [tuple(r) for r in doubled.collect()] == [(1, 200), (2, 400)]
    script = tmp_path / "q.sql"
    script.write_text("SELECT SAFE_DIVIDE(value, NULLIF(id - 1, 0)) AS r FROM {numbers}")
    assert rows(run_sql(spark, sql_file=script, tables={"numbers": numbers})) == [
        (None,),
        (200.0,),
    ]
    assert run_sql(spark, sql="SELECT 1 AS x, 'hello' AS y", sql_file=script).first().y == "hello"
    with pytest.raises(ValueError, match="sql or sql_file"):
        run_sql(spark)


def test_safe_divide_is_inlined(spark):
    df = run_sql(spark, "SELECT SAFE_DIVIDE(id, 2) AS r FROM {t}", tables={"t": spark.range(3)})
    assert df.agg(F.sum("r")).first()[0] == 1.5


def test_digest_does_not_depend_on_order_but_on_every_value(spark):
    data = [(1, "a", 0.5, [1.25, None]), (2, None, -3.0, None), (2, None, -3.0, None)]
    df = spark.createDataFrame(data, "i int, s string, x double, a array<double>")
    digest = rows(sources.table_digest(df))
    assert [(d[0], d[1], d[2]) for d in digest] == [
        ("a", 3, 1), ("i", 3, 3), ("s", 3, 1), ("x", 3, 3)
    ]
    assert rows(sources.table_digest(df.repartition(3).orderBy(F.desc("i")))) == digest
    for changed in (df.distinct(), df.withColumn("x", F.col("x") + (F.col("i") == 1).cast("int"))):
        assert rows(sources.table_digest(changed)) != digest
