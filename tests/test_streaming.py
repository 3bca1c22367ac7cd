import os

from driftline.streaming.monitor import watch


def test_batches_over_the_threshold_are_told(spark, tmp_path):
    base = spark.range(200).selectExpr("cast(id as double) v", "concat('k', id % 3) k")
    spark.range(200).selectExpr("cast(id as double) v", "concat('k', id % 3) k").coalesce(1).write.parquet(f"{tmp_path}/in")
    told = []
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    query = watch(stream, base, 0.2, lambda n, c: told.append((n, c))).option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    spark.range(200).selectExpr("cast(id + 500 as double) v", "concat('k', id % 3) k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert told == [(1, ["v"])]


def test_steps_that_end_on_the_driver_leave_no_tables(spark, tmp_path):
    from driftline.operators import rows
    from driftline.plans.diff import diff_frames
    from driftline.plans.state import first_samples

    folder = rows.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("driftline-")}
    before = tables()
    a = spark.range(300).selectExpr("id", "cast(id as double) v", "concat('k', id % 3) k")
    b = spark.range(300).selectExpr("id", "cast(id + 9 as double) v", "concat('k', id % 5) k")
    told = []
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batches = spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in")
    query = watch(batches, a, 0.2, lambda n, c: told.append(c)).option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert diff_frames(a, b, order_by=["id"]).column_drifts["v"].ks_statistic is not None
    assert first_samples(a, 5, ["id"])["v"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert tables() == before
