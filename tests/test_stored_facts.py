"""Stored facts stay in the tasks that made them."""

from pyspark.sql import functions as F

from marketlens.sources.store import TableStore


def test_clustered_tables_are_written_without_a_shuffle(spark):
    rows = [(i, f"2000-{1 + i % 2:02d}-{1 + i % 28:02d}") for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "id long, d string").select("id", F.col("d").cast("date").alias("d")).repartition(4, "id")
    given = {(r["id"], r["d"]) for r in df.collect()}
    parts = df.select("id", F.spark_partition_id().alias("part")).collect()
    out = TableStore(spark, "test-stored-facts").table("facts", lambda: df, "d")
    found = out.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    assert len(found) == len(rows) and {(r["id"], r["d"]) for r in found} == given
    files = {r["id"]: r["file"] for r in found}
    assert len({(r["part"], files[r["id"]]) for r in parts}) == len(set(files.values())) == len({r["part"] for r in parts})
    for file in set(files.values()):
        dates = [r["d"] for r in sorted(found, key=lambda r: r["at"]) if r["file"] == file and r["d"] is not None]
        assert dates == sorted(dates)
