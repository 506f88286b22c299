"""Token counts from an exact histogram of encoded lengths.

Documents shrink to (length, number of documents) before the only shuffle, so what is sorted afterwards is bounded by
the number of distinct lengths and not by the number of documents.  Running sums from either end of that histogram then
answer, for any context limit, how many documents and tokens fit, how many are cut, and what the quantiles are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import encode_decode


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``(n_tokens, n_docs)`` over all rows of ``docs``; null and empty texts have length 0, repeated rows all count."""
    keyed = docs.select(F.lit(0).alias("k"), F.col(f"`{text}`").alias("text"))
    return encode_decode(keyed, path, want=(), keep=("k",)).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def at_limits(histogram: DataFrame, limits: list[int] | None = None) -> DataFrame:
    """Totals for every context limit: each length that occurs, or the given ``limits`` (which need not occur).

    Columns, all bigint but the last: ``context``; ``n_docs`` of exactly that length; ``docs_within`` and
    ``tokens_within`` for lengths up to the limit; ``docs_over`` and ``tokens_over`` for longer ones; ``tokens_kept``,
    the total when every document is cut at the limit; ``tokens_cut``, what that loses; ``share_within``, the quantile
    of the limit.  An empty histogram gives no row, or a row of zeros for each given limit with a null share.
    """
    rows = histogram.select(F.col("n_tokens").alias("context"), "n_docs", F.lit(False).alias("asked"))
    if limits is not None:
        asked = histogram.sparkSession.sql("SELECT explode(array({})) context".format(", ".join(f"{int(x)}L" for x in limits) or "CAST(NULL AS BIGINT)"))
        rows = rows.union(asked.where("context IS NOT NULL").select("context", F.lit(0).cast("bigint"), F.lit(True)))
        rows = rows.groupBy("context").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    tokens = F.col("context") * F.col("n_docs")
    up = Window.orderBy("context").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col("context").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    out = rows.select(
        "context", "n_docs", "asked",
        F.sum("n_docs").over(up).alias("docs_within"), F.sum(tokens).over(up).alias("tokens_within"),
        F.coalesce(F.sum("n_docs").over(down), zero).alias("docs_over"),
        F.coalesce(F.sum(tokens).over(down), zero).alias("tokens_over"),
    )
    out = out.withColumn("tokens_kept", F.col("tokens_within") + F.col("context") * F.col("docs_over"))
    out = out.withColumn("tokens_cut", F.col("tokens_over") - F.col("context") * F.col("docs_over"))
    all_docs = F.col("docs_within") + F.col("docs_over")
    out = out.withColumn("share_within", F.when(all_docs > 0, F.col("docs_within") / all_docs))
    return (out.where("asked") if limits is not None else out).drop("asked")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least this share of the documents does not exceed."""
    table = at_limits(histogram).select("context", "share_within")
    picks = [F.min(F.when(F.col("share_within") >= s, F.col("context"))).alias(f"q{i}") for i, s in enumerate(shares)]
    stacked = ", ".join(f"CAST({s} AS DOUBLE), q{i}" for i, s in enumerate(shares))
    return table.agg(*picks).selectExpr(f"stack({len(shares)}, {stacked}) AS (share, n_tokens)")
