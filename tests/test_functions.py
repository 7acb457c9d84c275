"""Column functions against the Python behaviour they reproduce."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from remitframe.functions import edi


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_strip(spark):
    texts = [" a ", "\na\r\n", "\x1ca\x1f", "\xa0a ", "a b", "", " \t", "​a", "\x85a\x0b"]
    assert [v for v, in values(spark, texts, edi.strip(F.col("x")))] == [t.strip() for t in texts]


def test_split_on_any_separator(spark):
    for sep in ["*", "|", "^", "\\", ".", "\n", "\x1d", "a", "1", "é", "[", "$"]:
        texts = [f"p{sep}q{sep}{sep}", sep, "", "zz"]
        assert [v for v, in values(spark, texts, edi.split_on(F.col("x"), F.lit(sep)))] == [
            t.split(sep) for t in texts], sep


def test_elements(spark):
    segment = edi.elements_of(F.col("x"), F.lit("*"))
    got = values(spark, ["NM1* A *　*x"], edi.safe_element(segment, 1),
                 edi.safe_element(segment, 2), edi.safe_element(segment, 9),
                 edi.safe_element(segment, 2, None), edi.segment_name(segment))
    assert got == [("A", "", "", None, "NM1")]


def test_decimals(spark):
    texts = ["1", "1.005", "-2.5", ".5", "5.", "1E3", "1e11", "abc", "", "1_000", "NaN", "0.00"]
    got = values(spark, texts, edi.safe_decimal(F.col("x")), edi.overflows(F.col("x")),
                 edi.is_zero(F.col("x")))
    assert [g[0] for g in got] == [
        Decimal(1), Decimal("1.01"), Decimal("-2.50"), Decimal("0.50"), Decimal(5),
        Decimal(1000), None, None, None, None, None, Decimal(0)]
    assert [t for t, g in zip(texts, got) if g[1]] == ["1e11"]
    assert [t for t, g in zip(texts, got) if g[2]] == ["0.00"]


def test_dates(spark):
    texts = ["20230115", "20230231", "00000101", "2023011", "20240229", "2023-1-5", "99991231"]
    assert [v for v, in values(spark, texts, edi.safe_date(F.col("x")))] == [
        date(2023, 1, 15), None, None, None, date(2024, 2, 29), None, date(9999, 12, 31)]


def test_composites_and_status(spark):
    assert values(spark, ["", "a", ":B:1"], edi.split_composite(F.col("x"), F.lit(":"))) == [
        ([],), (["a"],), (["", "B", "1"],)]
    assert [v for v, in values(spark, ["1", "4", "22", "5", ""], edi.claim_status_for(
        F.col("x")))] == ["paid", "denied", "void", None, None]


def test_ids_sort_by_upload_then_position(spark):
    df = spark.createDataFrame([(1, 2**31 - 1), (2, 1), (2**31 - 1, 5)], "u long, p int")
    key = edi.entity_id(F.col("u"), F.col("p"))
    rows = df.select(key.alias("k"), edi.position_of(key).alias("p")).collect()
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    assert [r.p for r in rows] == [2**31 - 1, 1, 5]
