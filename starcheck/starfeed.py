"""EDI text rendered from an order / lineitem star schema.

Orders become claims, lineitems their service lines, and finished orders payments. All rows are
used. Only attributes of the data decide what an order or line looks like in the text, including
its faults: orders under 5,000 come without a charge, lines without discount and tax without a
procedure code, and a few returned lines with a place of service that is too long, which makes
the whole file unacceptable.

Rows are laid out by a range partitioning over the full order, so that neither a huge order nor a
huge file has to fit in one task. Their text is made behind it, in small blocks.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.operators.ordinal import sorted_partitions
from remitframe.session import (
    FILE_BITS, drop_old_shuffles, kept_in_files, shared_dir, small_methods,
)
from remitframe.sources.files import DELIMITERS, Source, with_delimiters

ORDERS_PER_FILE = 500      # orders per submission file
CUSTOMERS_PER_FILE = 100   # customers per remittance file
AS_OF = "2002-02-01"
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submission_seq(order_key: Column) -> Column:
    """Odd numbers: submissions and remittances take turns, so payments can come first."""
    return F.floor(order_key / ORDERS_PER_FILE) * 2 + 1


def remittance_seq(customer_key: Column) -> Column:
    return F.floor(customer_key / CUSTOMERS_PER_FILE) * 2 + 2


def _money(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(12,2)").cast("string")


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def _segments(ending: str, *parts: Column) -> Column:
    """Join segments, each with its ending; null segments are left out."""
    return F.concat(F.concat_ws(ending, *parts), F.lit(ending))


def _isa(seq: Column, sender: str, receiver: str, e: str, c: str, t: str) -> Column:
    fixed = e.join(["ISA", "00", " " * 10, "00", " " * 10, "ZZ", f"{sender:<15}", "ZZ",
                    f"{receiver:<15}", "230101", "1200", "^", "00501", ""])
    return F.concat(F.lit(fixed), F.lpad(seq.cast("string"), 9, "0"),
                    F.lit(e.join(["", "0", "P", c]) + t))


def _with_ends(rows: DataFrame, kind: str) -> DataFrame:
    """One row for the start of each file and one for its end."""
    seqs = rows.select("upload_seq").distinct()
    for name, k in ((f"{kind}_head", -1), (f"{kind}_tail", 2**62)):
        rows = rows.unionByName(seqs.select("upload_seq", F.lit(k).cast("long").alias("k"),
                                            F.lit(name).alias("form")), True)
    return rows


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 837 text is made of: ``upload_seq, k, form`` and the columns of an order or a line."""
    orders = _table(spark, sf_dir, "orders").join(
        _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey")).select(
        submission_seq(F.col("o_orderkey")).alias("upload_seq"), F.col("o_orderkey").alias("k"),
        F.lit("claim").alias("form"), *_ORDER, "c_name", "c_mktsegment")
    lines = _table(spark, sf_dir, "lineitem").select(
        submission_seq(F.col("l_orderkey")).alias("upload_seq"), F.col("l_orderkey").alias("k"),
        F.lit("line").alias("form"), *_LINE_ORDER)
    # Files are those that an order has.
    return lines.unionByName(_with_ends(orders, "837"), True)


def _submission_text() -> dict[str, Column]:
    """837 text by form of row."""
    lit = F.lit
    number = F.concat(lit("CLM-"), F.col("k").cast("string"))
    low, high = F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority") == "2-HIGH"
    dx = F.concat(lit("D"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    place = F.when(F.col("o_orderstatus") == "F", "11").when(
        F.col("o_orderstatus") == "O", "21").otherwise("22")
    claim = _segments(
        "~\n",
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(lit("N1*PR*"), F.col("c_mktsegment"))),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(lit("NM1*IL*1*DOE*JO****MI*"), F.col("c_name"))),
        F.concat(lit("CLM*"), number, lit("*"),
                 F.when(F.col("o_totalprice") < 5000, "").otherwise(_money("o_totalprice")),
                 lit("***"), place, lit(":B:"), F.when(low, "7").otherwise("1"), lit("*Y*A")),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
               F.concat(lit("DTP*472*D8*"), _day(F.col("o_orderdate")))),
        F.when(low, F.concat(lit("REF*F8*PRIOR-"), F.col("k").cast("string"))),
        F.concat(lit("HI*ABK:"), dx, F.when(high, F.concat(lit("**ABF:X"), dx)).otherwise("")),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(lit("HI*ABJ:*ABF:Y"), dx)))
    line = F.col
    procedure = F.when((line("l_discount") == 0) & (line("l_tax") == 0), "").otherwise(
        F.lpad((line("l_partkey") % 100000).cast("string"), 5, "0"))
    pos = F.when((line("l_quantity") >= 50) & (line("l_discount") >= 0.1)
                 & (line("l_tax") >= 0.08) & (line("l_returnflag") == "R"), "999").otherwise(
        F.lpad((line("l_suppkey") % 90).cast("string"), 2, "0"))
    service = _segments(
        "~\n",
        F.concat(lit("SV1*HC:"), procedure,
                 F.when(line("l_returnflag") != "N", F.concat(lit(":"), line("l_returnflag")))
                 .otherwise(""),
                 lit("*"), _money("l_extendedprice"), lit("*UN*"), _money("l_quantity"),
                 lit("*"), pos),
        F.concat(lit("DTP*472*D8*"), _day(line("l_shipdate"))))
    head = F.concat(
        _isa(F.col("upload_seq"), "SUBMITTER", "PAYER", "*", ":", "~"),
        lit("\nGS*HC*SUBMITTER*PAYER*20230101*1200*1*X*005010X222A1~\n"
            "ST*837*0001*005010X222A1~\nBHT*0019*00*BATCH*20230101*1200*CH~\n"))
    return {"line": service, "claim": claim, "837_head": head,
            "837_tail": lit("SE*1*0001~\nGE*1*1~\nIEA*1*1~\n")}


def _remittances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 835 text is made of: ``upload_seq, k, form`` and the columns of an order."""
    paid = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        remittance_seq(F.col("o_custkey")).alias("upload_seq"), F.col("o_orderkey").alias("k"),
        F.lit("payment").alias("form"), *_ORDER)
    return _with_ends(paid, "835")


def _remittance_text() -> dict[str, Column]:
    """835 text by form of row, with other delimiters than the submissions."""
    lit = F.lit
    key = F.col("k").cast("string")
    priority, finished = F.col("o_orderpriority"), F.col("o_orderstatus") == "F"
    total = F.col("o_totalprice").cast("decimal(12,2)")
    status = F.when(priority == "4-NOT SPECIFIED", "5").when(finished, "1").when(
        priority == "5-LOW", "22").otherwise("4")
    paid = F.when(status == "1", F.round(total * F.lit("0.8").cast("decimal(2,1)"), 2)
                  ).otherwise(lit(0).cast("decimal(12,2)"))
    billed = F.when(F.col("o_totalprice") < 5000, "").otherwise(_money(total))

    def clp(code, amount, suffix=""):
        return F.concat(lit("CLP|CLM-"), key, lit("|"), code, lit("|"), billed, lit("|"),
                        _money(amount), lit("||12|PCN"), key, lit(suffix))
    rest = _money(total - paid)
    payment = _segments(
        "\n",
        clp(status, paid),
        F.when(priority == "2-HIGH",
               F.concat(lit("DTM|050|"), _day(F.date_add("o_orderdate", 30)))),
        F.concat(lit("CAS|CO|"), F.when(status == "1", "45").otherwise("50"), lit("|"), rest,
                 F.when(priority == "3-MEDIUM", "|1|97|x|1|2|7.50|1||9").otherwise("")),
        F.when(status.isin("4", "22"), F.concat(
            lit("LQ|"), F.when(priority == "5-LOW", "M").otherwise("HE|N"),
            F.lpad((F.col("k") % 1000).cast("string"), 3, "0"))),
        F.when((priority == "1-URGENT") & finished, clp(lit("22"), lit(0), "R")))
    head = F.concat(
        _isa(F.col("upload_seq"), "PAYER", "PROVIDER", "|", ">", "\n"),
        lit("GS|HP|PAYER|PROVIDER|20230201|1200|2|X|005010X221A1\nST|835|0002|005010X221A1\n"
            "BPR|I|1200|C|ACH\nTRN|1|TRACE|1\nDTM|050|20011231\nN1|PR|PAYER\n"))
    return {"payment": payment, "835_head": head, "835_tail": lit("SE|1|0002\nGE|1|2\nIEA|1|2\n")}


def star_source(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> Source:
    """The whole star schema as EDI text blocks, kept in the source's ``folder``."""
    folder = f"{shared_dir(spark)}/text-{uuid4().hex}"
    rows = _submissions(spark, sf_dir).unionByName(_remittances(spark, sf_dir), True)
    text = F.lit(None).cast("string")
    for form, made in reversed((_submission_text() | _remittance_text()).items()):
        text = F.when(F.col("form") == form, made).otherwise(text)
    with small_methods(spark):   # seven forms of text in one expression
        laid_out = sorted_partitions(
            rows, ["upload_seq", "k", *[F.col(c).asc_nulls_first() for c in _LINE_ORDER]],
            partitions, ["upload_seq", "k", text.alias("text")],
            keep=lambda df: kept_in_files(df, folder))
    drop_old_shuffles(spark)   # of the sort
    # A chunk is what one file of the folder holds of an EDI file, as a task reads that whole.
    chunk = F.shiftleft("part", 33 - FILE_BITS) + F.shiftright("row_in_part", FILE_BITS)
    laid_out = laid_out.select("upload_seq", chunk.alias("chunk"),
                               F.col("row_in_part").alias("block_seq"), "k", "text")
    # Delimiters come from the text itself: the head block of a file starts with its ISA.
    heads = laid_out.where("k = -1")
    files = with_delimiters(
        heads, F.substring("text", F.locate("ISA", F.col("text")), F.lit(106))).select(
        "upload_seq", F.concat(_file_name(F.col("upload_seq")), F.lit(".edi")).alias("file_name"),
        *DELIMITERS, "file_error")
    # Two kinds of sender exist, so the delimiters follow from the parity of the number.
    odd = F.col("upload_seq") % 2 == 1
    blocks = laid_out.select(
        "upload_seq", "chunk", "block_seq", "text",
        F.when(odd, "*").otherwise("|").alias("element_sep"),
        F.when(odd, ":").otherwise(">").alias("component_sep"),
        F.when(odd, "~").otherwise("\n").alias("terminator"))
    return Source(files, blocks, folder)


def _file_name(seq: Column) -> Column:
    return F.concat(F.when(seq % 2 == 1, "claims-").otherwise("payments-"), seq.cast("string"))


def code_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code table: nations stand for places of service, regions for adjustment reasons."""
    nation = _table(spark, sf_dir, "nation").select(
        F.lit("pos").alias("code_type"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"),
        F.col("n_name").alias("description"))
    # Reasons in use first; the other regions get codes that no adjustment has.
    key = F.col("r_regionkey")
    reasons = _table(spark, sf_dir, "region").select(
        F.lit("carc").alias("code_type"),
        F.when(key == 0, "45").when(key == 1, "50").otherwise(
            F.concat(F.lit("R"), key.cast("string"))).alias("code"),
        F.col("r_name").alias("description"))
    remarks = reasons.select(F.lit("rarc").alias("code_type"), F.when(
        F.col("code") == "45", "N130").otherwise(F.concat(F.lit("N"), "code")).alias("code"),
        "description")
    statuses = _table(spark, sf_dir, "region").select(
        F.lit("claim_status").alias("code_type"), (key + 1).cast("string").alias("code"),
        F.col("r_name").alias("description"))
    return nation.unionByName(reasons).unionByName(remarks).unionByName(statuses)
