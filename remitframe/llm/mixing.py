"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the sources below languages below domains (any levels can be given). A token budget goes
down from the root: the children of a node share its budget by weight, and what a child cannot use
(its leaves have too few tokens, even read ``max_epochs`` times) goes to its siblings in proportion
to their weights. As a node never gets more than its leaves can use, a shortage leaves a family only
when no sibling can take it. A leaf then gives whole epochs plus a prefix of one more epoch, in an
order seeded by epoch and document; the prefix ends before the first document that would exceed the
budget. Rows with the same id have the same place and are taken together.

Shares are integers, so they don't depend on the order of sums. Rounding down leaves fewer tokens
unspent than there are nodes. The tree has a row per leaf and is worked on by windows per parent.
The prefix of a leaf is found by sums over ranges of its order, so that a source with a third of
all documents is spread over many tasks.

Defined results: null level values count as empty strings; a null text has no tokens; documents
without tokens cost nothing and follow the same order; repeated rows count each; an
empty table gives an empty result. Extra columns are kept unless they have the name of an added
column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitframe.llm.common import staged, text_of
from remitframe.session import checked_join

# Documents of a leaf that one task orders.
RANGE_ROWS = 1_000
_P = "_mix_"


def estimated_tokens(text_col: str = "text") -> Column:
    """Four bytes of text are about one token."""
    return F.ceil(F.octet_length(text_of(text_col)) / F.lit(4)).cast("long")


def _wide(column: Column, digits: int) -> Column:
    return column.cast(f"decimal({digits},0)")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children that have ``parent_budget``, ``weight`` and ``capacity``."""
    key = [F.col(c) for c in parent] or [F.lit(0)]
    # Those that fill up first come first.
    order = [F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(
        F.lit(float("inf"))), F.col(name)]
    up_to = Window.partitionBy(*key).orderBy(*order)
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    onward = up_to.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    family = Window.partitionBy(*key)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = (F.col("weight") > 0) & (
        _wide(F.col("parent_budget") - taken, 20) * _wide(F.col("weight"), 12)
        >= _wide(F.col("capacity"), 20) * _wide(F.sum("weight").over(onward), 17))
    marked = children.withColumn("full", full)
    rest = F.col("parent_budget") - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))
    others = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    # Whole-number division of decimals, which the product of two longs may need.
    part = F.expr("cast((cast(rest as decimal(20,0)) * cast(weight as decimal(12,0))) "
                  "div cast(others as decimal(17,0)) as bigint)")
    return marked.withColumn("rest", rest).withColumn("others", others).withColumn(
        "budget", F.when(F.col("full"), F.col("capacity")).when(
            F.col("weight") > 0, part).otherwise(F.lit(0)).cast("long")).drop(
        "full", "rest", "others")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: int,
            max_epochs: int) -> DataFrame:
    """Token budget of every leaf. ``leaves`` has the level columns and ``tokens``.

    ``weights`` gives each level a column over the level columns down to its own: a whole number,
    not negative. Levels without an entry share evenly.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    known: DataFrame | None = None
    for depth, name in enumerate(levels):
        upper, here = levels[:depth], levels[:depth + 1]
        nodes = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weights.get(name, F.lit(1)).cast("long"))
        if known is None:
            root = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("parent_budget", F.least(
                F.lit(budget).cast("long"), root))
        else:
            nodes = nodes.join(known, upper)
        known = _share(nodes, upper, name).select(
            *here, F.col("budget").alias("parent_budget"))
    return known.withColumnRenamed("parent_budget", "budget").join(
        leaves.select(*levels, "tokens", "documents"), levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column],
        budget: int | None = None, budget_share: float = 0.75, max_epochs: int = 2,
        seed: int = 17, id_col: str = "doc_id", tokens: Column | None = None,
        text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``copies`` (how often the mixture holds the document, 0 for none)
    and ``leaf_budget``. Without ``budget`` it is ``budget_share`` of all tokens."""
    names = list(levels)
    size = estimated_tokens(text_col) if tokens is None else tokens
    keys = {f"{_P}{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    narrow = docs.select(*[c.alias(n) for n, c in zip(names, keys.values(), strict=True)],
                         size.alias("n_tokens"), ident.alias("id"))
    leaves = staged(narrow.groupBy(*names).agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    plan = staged(budgets(leaves, names, weights, budget, max_epochs).select(
        *names, F.col("budget").alias("leaf_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(
            F.lit(max_epochs)).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(
            F.lit(0)).alias("part"),
        F.ceil(F.col("documents") / range_rows).cast("long").alias("ranges")), "budgets")

    # The last place of each leaf's prefix. Only keys and sizes are ordered, range by range.
    placed = checked_join(narrow, plan.where("part > 0"), names, "inner").withColumn(
        "place", _place(seed, F.col("epochs"), F.col("id"))).withColumn("range", F.floor(
            F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("ranges")
            / F.lit(1 << 32)).cast("long"))
    earlier = Window.partitionBy(*names).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("tokens")).select(
        *names, "range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*names, "range").orderBy("place").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    cuts = placed.withColumn("upto", F.sum("n_tokens").over(inside)).join(
        offsets, [*names, "range"]).where(F.col("offset") + F.col("upto") <= F.col("part")
        ).groupBy(*names).agg(F.max("place").alias("cut"))
    chosen = staged(plan.join(cuts, names, "left").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "leaf_budget",
        F.col("epochs").alias(f"{_P}epochs"), F.col("cut").alias(f"{_P}cut")), "mixture")

    # Texts stay where they are: each document looks up the last place of its leaf.
    added = ("n_tokens", "copies", "leaf_budget")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    in_prefix = _place(seed, F.col(f"{_P}epochs"), F.col(f"{_P}id")) <= F.col(f"{_P}cut")
    return checked_join(docs.select(*kept, *[c.alias(k) for k, c in keys.items()],
                                    size.alias("n_tokens"), ident.alias(f"{_P}id")),
                        chosen, list(keys), "left").withColumn(
        "copies", F.col(f"{_P}epochs") + F.when(in_prefix, 1).otherwise(0)).select(
        *kept, "n_tokens", "copies", "leaf_budget")


def _place(seed: int, epoch: Column, ident: Column) -> Column:
    """Place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), ident))
