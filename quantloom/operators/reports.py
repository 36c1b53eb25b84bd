"""Reports put together from several operators: one row of findings, or one a variant; text is made of them in ``report``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import sharpe_trigger
from .simulate import grid_winner

#: Holdout score that satisfies the search for a strategy.
SATISFIED = 1.0


def model_report(panel: DataFrame, held_out: DataFrame, threshold: float = 0.005, recent: int = 5) -> DataFrame:
    """One row: extent of the panel, pooled score of the held-out predictions, and the latest trades, newest last.

    A trade is (dt, ticker, pred, actual); trades of one day are ordered by ticker. Without
    trades the score is NULL and the list empty.
    """
    extent = panel.agg(F.countDistinct("dt").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    last = held_out.where(F.col("pred") > threshold).orderBy(F.desc("dt"), F.desc("ticker")).limit(recent)
    line = F.format_string("%s %s %+.4f %+.4f", F.col("dt").cast("string"), "ticker", "pred", "actual")
    text = last.agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("recent_trades"))  # ``recent`` rows
    return extent.join(F.broadcast(sharpe_trigger(held_out, threshold=threshold))).join(F.broadcast(text))  # one row each


def variants_report(grid: DataFrame, satisfied: float = SATISFIED) -> DataFrame:
    """One row a variant: scores of both parts, whether it won the search, and whether the winner's holdout score satisfies."""
    score = lambda part: grid.where(F.col("part") == part).select("variant", F.col("sharpe").alias(f"{part}_sharpe"), F.col("n_trades").alias(f"{part}_n"), F.col("hit_rate").alias(f"{part}_hit"))
    d = score("search").join(score("holdout"), "variant", "full")
    winner = grid_winner(grid).select(F.col("variant").alias("won"))  # one row
    d = d.join(F.broadcast(winner), F.col("variant") == F.col("won"), "left")
    return d.select("variant", "search_sharpe", "search_n", "search_hit", "holdout_sharpe", "holdout_n", "holdout_hit", F.col("won").isNotNull().alias("won"), (F.col("won").isNotNull() & F.coalesce(F.col("holdout_sharpe") >= satisfied, F.lit(False))).alias("satisfied"))
