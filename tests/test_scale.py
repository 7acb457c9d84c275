"""Plans and results under skew."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from remitframe.operators import reconcile
from remitframe.session import checked_join, split_join
from tests.edi_texts import new_folder


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_claim_number_is_split(spark):
    """One claim number has a third of all payments: matching stays exact and is divided."""
    payments = spark.range(0, 90_000, 1, 8).select(
        (F.col("id") + 2**33).alias("remittance_claim_id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), "id"))
        .alias("claim_number"))
    claims = payments.where("remittance_claim_id % 6 = 1").select(
        "claim_number", (F.col("remittance_claim_id") - 2**32).alias("claim_id"))
    folder = new_folder()
    reconcile.first_mentions(claims, payments).write.mode("overwrite").parquet(folder)
    mentions = spark.read.parquet(folder)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1,
                  spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
                  spark__sql__adaptive__coalescePartitions__enabled="false",
                  spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
                  spark__sql__adaptive__skewJoin__skewedPartitionFactor=2):
        resolved = reconcile.resolve(payments, mentions)
        assert "skew=true" in final_plan(resolved)
        expected = {}
        for r in sorted(claims.collect(), key=lambda r: r.claim_id):
            expected.setdefault(r.claim_number, r.claim_id)
        for r in payments.orderBy("remittance_claim_id").collect():
            expected.setdefault(r.claim_number, r.remittance_claim_id)
        rows = resolved.collect()
    assert len(rows) == 90_000
    assert all(r.claim_id == expected[r.claim_number] for r in rows)


def test_broadcast_only_when_small(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 50)
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        near = checked_join(big, small, "k", "left", limit=50)
        far = checked_join(big, small, "k", "left", limit=49)
        assert "BroadcastHashJoin" in final_plan(near)
        assert "SortMergeJoin" in final_plan(far)
        assert sorted(near.collect()) == sorted(far.collect())


def test_hot_key_is_salted(spark):
    """A key with a third of the rows: the same rows come out, from several salts."""
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k"))
    right = left.select("k").distinct().where("k <> 7").withColumn("v", F.col("k") * 10)
    plain = sorted(map(str, left.join(right, "k").collect()))
    salted = split_join(left, right, "k", "id", hot_rows=50)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, salted.collect())) == plain
