"""A warehouse over files that have changed."""

import shutil

from marketlens.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"


def test_refresh_sees_new_files(spark, tmp_path):
    folder = f"{tmp_path}/input"
    shutil.copytree(FOLDER, folder, copy_function=shutil.copyfile)
    before = Warehouse.open(spark, folder).stg("suppliers").count()
    more = spark.read.parquet(f"{FOLDER}/supplier.parquet").selectExpr("s_suppkey + 1000 AS s_suppkey", "* EXCEPT (s_suppkey)")
    both = spark.read.parquet(f"{FOLDER}/supplier.parquet").unionByName(more)
    both.coalesce(1).write.parquet(f"{tmp_path}/new")
    (tmp_path / "input/supplier.parquet").chmod(0o600)
    shutil.copyfile(next((tmp_path / "new").glob("part-*.parquet")), f"{folder}/supplier.parquet")
    assert Warehouse.open(spark, folder).stg("suppliers").count() == before
    assert Warehouse.refresh(spark, folder).stg("suppliers").count() == 2 * before
