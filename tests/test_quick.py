"""Quicker forms of shared steps, with the results of the plain ones."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from remitframe.functions.edi import is_blank, overflows, safe_date, segment_name, strip
from remitframe.operators.features import CATEGORICAL, FeatureEngineer
from remitframe.operators.integrity import with_row_rules
from remitframe.operators.ordinal import sorted_partitions
from remitframe.operators.segments import explode_segments, mark_segments
from remitframe.plans.ingest import annotate
from remitframe.session import setting
from remitframe.sources.files import Source
from starcheck import queries as star


def test_columns_are_made_behind_the_sort_and_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(v):
        runs.add(1)
        return v * 2
    rows = spark.range(20).withColumn("unused", F.lit("x"))
    out = sorted_partitions(rows, [F.desc("id")], 3, [
        "id", F.udf(counted, "long")("id").alias("twice")])
    assert out.columns == ["id", "twice", "part", "row_in_part"]
    assert [r.twice for r in out.orderBy("part", "row_in_part").collect()] == [
        2 * n for n in range(19, -1, -1)]
    assert runs.value == 20


def test_quick_text_functions_keep_the_results(spark):
    texts = [" a", "a\r\n", "\u00e9", "\u3000x\u00a0", "", "\n", "~", "!", "a b", "\x1ca", None]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(c).alias("s"), is_blank(c).alias("b"), segment_name(F.array(c)).alias("n"))
    for r in got.collect():
        assert r.s == (None if r.t is None else r.t.strip())
        assert r.b == (None if r.t is None else not r.t.strip())
        assert r.n == (None if r.t is None else r.t.upper())
    numbers = {"9999999999": False, "99999999999": True, "1e10": True, "1E9": False, "9999999999.999": True,
               "0000000000001": False, "x": False, "": False, None: False}
    got = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", overflows(c).alias("o"))
    assert {r.t: r.o for r in got.collect()} == numbers
    days = {"20240229": dt.date(2024, 2, 29), "20230229": None, "20231301": None, "00000101": None,
            "2023010": None, "99991231": dt.date(9999, 12, 31), None: None}
    got = spark.createDataFrame([(t,) for t in days], "t string").select("t", safe_date(c).alias("d"))
    assert {r.t: r.d for r in got.collect()} == days


class _Staged(Exception):
    pass


def _blocks(spark, text):
    return spark.createDataFrame([(1, 0, 0, text, "*", ":", "~")], (
        "upload_seq long, chunk long, block_seq long, text string, element_sep string, "
        "component_sep string, terminator string"))


def test_segments_are_split_only_before_the_scan(spark):
    class Store:
        def stage(self, name, batch, df, family=None):
            raise _Staged(df._jdf.queryExecution().optimizedPlan().toString())
    with setting(spark, "spark.sql.debug.maxToStringFields", "1000"), pytest.raises(
            _Staged) as staged:
        annotate(Source(None, _blocks(spark, "ST*837*1~")), Store(), 0)
    above, scan, below = str(staged.value).partition("MapInArrow")
    assert scan and "split(" not in above and "split(" in below


def test_row_rules_from_the_elements_of_the_marks(spark):
    units = {"0": None, "0e999": None, "000000000000": None, "99999999": None, "x": None,
             "123456789": "numeric overflow in claim_lines.units",
             "1e9": "numeric overflow in claim_lines.units"}
    text = "".join(f"SV1*HC:1*10*UN*{u}*11~" for u in units) + "SV1*HC:1*10*UN*1*999~HI*A:" + "9" * 11 + "~"
    marked = mark_segments(explode_segments(_blocks(spark, text)), keep_elements=True)
    got = [r.row_rule for r in with_row_rules(marked).orderBy("idx").collect()]
    assert got == [*units.values(), "value too long for claim_lines.place_of_service(2)",
                   "value too long for diagnoses.diagnosis_code(10)"]


def test_scoring_reads_its_features_once(spark, monkeypatch):
    rows, built = spark.sparkContext.accumulator(0), []

    def counted(v):
        rows.add(1)
        return v

    class Model:
        def transform(self, df, validate, keep):
            return df.withColumn("f", F.udf(counted, "long")("f"))

    def scores(features, model):
        return features.select("claim_id", "denied", F.lit(0.1).alias("denial_probability"),
                               F.lit("low").alias("risk_level"))
    frame = spark.range(20).select(F.col("id").alias("claim_id"), F.lit(0).alias("denied"), "id",
                                   F.col("id").alias("f"))
    for name, value in {"star_model": lambda *a: Model(), "star_store": lambda *a: None,
                        "build_dataset": lambda s: frame, "score_denials": scores,
                        "train_denial_model": lambda f: [built.append(f.agg(F.sum("f")).first())
                                                         for _ in range(3)]}.items():
        monkeypatch.setattr(star, name, value)
    got = star.denial_scores(spark, "none")
    assert got.where("in_range and in_band").count() == 20 and len(built) == 3
    assert rows.value == 20


@pytest.mark.parametrize("run", ["features", "features_saved", "at_once"])
def test_claims_are_joined_once_for_fit_and_features(spark, monkeypatch, run):
    """Each row of the training frame is computed once, though the fit and the features both read it."""
    rows = spark.sparkContext.accumulator(0)

    def counted(v):
        rows.add(1)
        return v
    frame = spark.range(20).select(
        F.col("id").alias("claim_id"), F.udf(counted, "double")(F.col("id").cast("double")).alias(
            "total_charge_amount"), F.lit(2).alias("line_count"), F.lit(1).alias("diagnosis_count"),
        *[F.lit(1.0).alias(c) for c in ("total_units", "total_billed_amount")],
        *[F.lit("2020-01-01").cast("date").alias(c) for c in ("service_from_date",
                                                              "service_to_date")],
        F.lit(True).alias("has_modifier"), *[F.lit("A").alias(c) for c in CATEGORICAL])
    for name, value in {"star_store": lambda *a: None, "build_dataset": lambda s: frame,
                        "_models": {}}.items():
        monkeypatch.setattr(star, name, value)
    got = FeatureEngineer().fit_transform(frame) if run == "at_once" else star.queries()[run](
        spark, "none")
    assert got.agg(F.sum("high_charge_claim")).first()[0] == 5
    assert rows.value == 20
