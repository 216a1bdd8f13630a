from tessera.llm import common


def test_spread(spark, tmp_path):
    """Only a table that its files don't spread is dealt out."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(1000).repartition(4 * cores).write.parquet(str(tmp_path / "many.parquet"))
    one, many = (common.read_spread(spark, str(tmp_path), n) for n in ("one", "many"))
    used = lambda df: df.selectExpr("spark_partition_id() AS p").distinct().count()
    assert used(one) == 2 * cores and one.count() == 1000
    assert "Exchange" in one._jdf.queryExecution().toString() and "Exchange" not in many._jdf.queryExecution().toString()


def test_names_and_chunks(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, b_ int")
    assert common.free_names(df, "a", "b", "c") == ["a_", "b__", "c"]
    assert list(common.chunks([5, 1, 9, 9, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(common.chunks([], 6)) == [] and list(common.chunks([0, 0], 6)) == [(0, 2)]


def test_written_table_is_in_the_shared_folder(spark):
    df = common.written(spark.range(10).where("id > 3"), "t")
    assert df.count() == 6 and all(f.startswith(common.shared_dir(spark).replace("file://", "file:///").replace("////", "///")) for f in df.inputFiles())
