"""Exact length histogram: token totals, quantiles and truncated totals for every context limit.

Documents are counted by encoded length, map-side first, so the shuffle carries
distinct lengths and a length that a third of all documents has is one number
per task.  All answers come from suffix sums over the histogram.  D distinct lengths need
D * D / 2 tokens, so the histogram is small against its input, but it is still not
put into one task: sums run inside cells of lengths and over the totals of cells.

Nulls and empty texts have length 0 and count as documents.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.storage import materialize
from tabaudit.llm.tokens import token_counts

# Neighbouring lengths whose sums are made in one task.
CELL = 1024


def length_histogram(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """``n_tokens``, ``n_docs``: how many documents have each encoded length.

    Written, a row for each length, as sums read it twice and would encode every document for each.
    """
    counts = token_counts(docs, path, text_column).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return materialize(counts, "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row for each length L that occurs, in the role of a context limit.

    ``docs_at_least`` and ``tokens_at_least`` count documents of L tokens or more,
    ``truncated_total`` is the tokens left when every document is cut to L,
    ``docs_truncated`` the documents that lose tokens, and ``quantile`` the share of
    documents with L tokens or fewer.
    """
    rows = histogram.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {CELL}").alias("cell")
    )
    cells = rows.groupBy("cell").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    # One row for each CELL lengths: a text of a billion tokens gives a million rows at most.
    later = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("cell").orderBy(F.col("n_tokens").desc())
    summed = rows.withColumns(
        {"docs_here": F.sum("n_docs").over(inside), "tokens_here": F.sum("tokens").over(inside)}
    ).join(cells, "cell")
    at_least, tokens_at_least = F.col("docs_here") + F.col("later_docs"), F.col("tokens_here") + F.col("later_tokens")
    longer = at_least - F.col("n_docs")
    return summed.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_total"),
        longer.alias("docs_truncated"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )


def totals_at(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Truncated totals at any limits, also such that no document has as its length.

    With S the next length that occurs at or above the limit, the documents below S lie
    below the limit whole, and those from S on are cut to it.
    """
    total, docs = F.first("total_tokens").alias("total"), F.first("total_docs").alias("docs")
    wanted = sums.select("*", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
    above = F.col("n_tokens") >= F.col("context_limit")
    nearest = F.min(F.when(above, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("nearest")
    found = wanted.groupBy("context_limit").agg(nearest, total, docs)
    cut = F.coalesce(F.col("nearest.docs_at_least"), F.lit(0))
    return found.select(
        "context_limit",
        (F.col("total") - F.coalesce(F.col("nearest.tokens_at_least"), F.lit(0)) + F.col("context_limit") * cut).alias("truncated_total"),
        F.col("total").alias("total_tokens"),
        F.col("docs").alias("total_docs"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share``, ``n_tokens``: the smallest length that so large a share of documents doesn't exceed."""
    wanted = sums.select("n_tokens", "quantile", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return wanted.groupBy("share").agg(F.min(F.when(F.col("quantile") >= F.col("share"), F.col("n_tokens"))).alias("n_tokens"))
