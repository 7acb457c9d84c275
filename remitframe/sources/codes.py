"""Loading code tables into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.contracts import CODE_TYPES
from remitframe.session import checkpointed
from remitframe.sources.store import Store

# Widths of the relational model being reproduced.
WIDTHS = {"code_type": 20, "code": 10, "description": 500}


def load_code_masters(store: Store, codes: DataFrame) -> int:
    """Adds (code_type, code, description) rows as one batch of their own; returns its number.

    All rows are accepted or none: the types have to be known, the texts fit their columns, and
    each (code_type, code) be new and given once.
    """
    codes = checkpointed(codes.select(*WIDTHS))
    wrong = F.col("code_type").isNull() | ~F.col("code_type").isin(*CODE_TYPES) | F.col(
        "code").isNull() | F.col("description").isNull()
    for name, width in WIDTHS.items():
        wrong |= F.coalesce(F.length(name) > width, F.lit(False))
    pairs = codes.select("code_type", "code").unionByName(
        store.read("code_masters").select("code_type", "code"))
    repeated = pairs.groupBy("code_type", "code").count().where("count > 1")
    for what, rows in (("of an unknown type, without code or description, or too long", codes.where(wrong)),
                       ("given or stored before", repeated)):
        sample = rows.limit(3).collect()
        if sample:
            raise ValueError(f"codes {what}: {[tuple(r) for r in sample]}")
    batch = max(store.batches(), default=-1) + 1
    store.write("code_masters", batch, codes)
    last = store.last_seq()
    store.commit(batch, last + 1, last)
    return batch
