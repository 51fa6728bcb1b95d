"""The one strategy of several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least utility of a candidate, and how far ahead of the next the best must be, in all or by share.
LEAST_UTILITY, LEAST_EDGE, LEAST_RELATIVE_EDGE = 0.00005, 0.00020, 0.10


def select_strategy(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's candidates (rec_id, eligible, utility, lower, confidence) the best: keys, status, winner, utility, edge, relative_edge.

    Candidates that are not eligible or not above the least utility do not count.
    Best is the greatest utility, then lower bound, then confidence, then id. It
    wins unless the next is too near both in all and by share of the next one's utility.
    Only two rows a key pass the window's limit.
    """
    fit = candidates.where(F.coalesce(F.col("eligible"), F.lit(False)) & F.col("rec_id").isNotNull() & (F.col("utility") > LEAST_UTILITY))
    best = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in ("utility", "lower", "confidence", "rec_id")])
    top = fit.withColumn("_n", F.row_number().over(best)).where("_n <= 2")
    of = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    x = top.groupBy(*keys).agg(of(1, "rec_id").alias("_rec"), of(1, "utility").alias("_first"), of(2, "utility").alias("_next"))
    edge = F.col("_first") - F.col("_next")
    relative = edge / F.greatest(F.abs("_next"), F.lit(LEAST_UTILITY))
    near = F.coalesce((edge < LEAST_EDGE) & (relative < LEAST_RELATIVE_EDGE), F.lit(False))
    x = candidates.select(*keys).distinct().join(x, keys, "left")
    none = F.col("_rec").isNull()
    status = F.when(none, "no_eligible_strategy").when(near, "no_clear_winner").otherwise("selected")
    return x.select(*keys, status.alias("status"), F.when(~none & ~near, F.col("_rec")).alias("winner"), F.when(~none & ~near, F.col("_first")).alias("utility"), edge.alias("edge"), relative.alias("relative_edge"))
