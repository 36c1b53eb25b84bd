"""Every operator as a query over the stand-in tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ablation, audit, features, health, metrics, policy, reports, signals, simulate, walkforward
from ..operators.spine import date_spine, in_blocks
from ..schema import CLUSTERS
from ..sources.scratch import keeper
from ..sources.sinks import latest_wins, nested_as_variant, variant_fields
from .standin import StandIn

Query = Callable[[StandIn], DataFrame]
LISTS = ["m_dn_0", "m_dn_3", "tval"]
COVERED = ["close", "high", "low", "tval", "m_dn_0", "m_dn_3", "is_unusual_volume", "clean_score"]
#: All features of the training panel.
FEATURES = ["broker_concentration", "net_flow_total", "n_brokers", "net_buy_ratio", "retail_presence_pct", "broker_correlation_1d", "momentum_1d", "volume_ratio"]


#: Queries that return stored values or their exact sums: decimals of seven to nine places,
#: which rounding at six would leave to the engines' treatment of ties.
EXACT = {"smart_money_features", "clean_prices", "gap_guarded_forward", "gap_guarded_lagged", "gap_guarded_extremes", "repair_prices", "rescale_netval", "latest_wins_upsert", "bag_holders"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many decimals, without negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def preds(t: StandIn) -> DataFrame:
    """A predictor that both engines compute alike: today's return."""
    return features.price_features(t.P).select("dt", "ticker", F.col("momentum_1d").alias("pred"), F.col("target").alias("actual")).where("pred is not null and actual is not null")


def fixes(t: StandIn) -> DataFrame:
    """Corrections for one ticker: a tenth of the close in June, other fields missing."""
    p = t.PD.where("ticker = 'Brand#7' and month(dt) = 6")
    return p.select("dt", "ticker", F.lit(None).cast("double").alias("open"), (F.col("close") / 10).alias("close"))


def backfilled(t: StandIn) -> DataFrame:
    """Flow whose rows before July came from a backfill (no bval)."""
    return t.B.select("*", F.when(F.month("dt") >= 7, F.lit(1.0)).alias("bval"))


def cumulated(t: StandIn) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "broker_code").orderBy("dt")
    return t.B.select("dt", "ticker", "broker_code", F.sum(F.col("netval").cast("decimal(24,9)")).over(w).cast("double").alias("cum_lot"))


def inventory(t: StandIn) -> DataFrame:
    n = F.col("netval").cast("decimal(24,9)")
    return t.B.groupBy("ticker", "broker_code").agg(F.sum(n).cast("double").alias("cum_lot"), (F.sum(n).cast("double") * 250).alias("cum_rp"))


def recorded(t: StandIn) -> DataFrame:
    d = signals.dashboard_top(t.M.withColumn("ticker", F.regexp_replace("ticker", "[0-9]", "A")), ["tval"])
    return signals.record_signals({"dashboard_tval": d.select("dt", "ticker"), "top_akum_bandar": signals.top_akum(t.M).select("dt", "ticker")}, tracked=["U1", "U2", "UAA"])


def actions(t: StandIn) -> DataFrame:
    p = simulate.limit_flags(t.P)
    return p.select("dt", "ticker", F.when(F.col("pct") > 0, 1).otherwise(0).alias("action"), "at_ara", "at_arb", F.col("pct").alias("daily_return"))


#: Texts as captures hold them, made of prices: numbers with commas and parentheses, amounts with units, lots, codes, titles.
CAPTURED = """
select dt as d1, date_add(dt, cast(k % 45 as int) - 5) as d2, ticker,
  case k % 4 when 0 then concat('(', format_number(close, 2), ')') when 1 then format_number(close, 2) when 2 then ticker else null end as num,
  case when k % 7 = 0 then null else concat('Rp ', format_number(close / 100, 2), element_at(array('Trl', 'Mlr', 'jt', 'rb', ''), cast(k % 5 as int) + 1)) end as rp,
  cast(k as double) * power(10, k % 4) + 7 as lot, substr(code, 1, cast(2 + k % 5 as int)) as code,
  case k % 3 when 0 then concat('Inventory chart: ', substr(code, 1, 4)) when 1 then concat(substr(code, 1, 4), ' - chart') else concat(lower(substr(code, 1, 4)), ' daily') end as title, close
from (select *, cast(volume as bigint) as k, reverse(upper(translate(ticker, '0123456789#', 'ABCDEFGHIJK'))) as code from {P})"""


def literals(t: StandIn) -> DataFrame:
    d = t.spark.sql(CAPTURED, P=t.P)
    return d.select(
        "d1",
        "d2",
        "ticker",
        S.parse_num("num").alias("num"),
        S.parse_rupiah("rp").alias("rupiah"),
        S.format_lot("lot").alias("lot"),
        S.is_equity_code("code").alias("equity"),
        S.ticker_from_title("title").alias("code_in_title"),
        S.ara_bound("close").alias("ara"),
        S.weekdays_between("d1", "d2").cast("long").alias("weekdays"),
    )


def guarded(t: StandIn, **kw) -> DataFrame:
    return audit.clean_panel(t.PD, **kw).drop("open", "high", "low", "volume")


def horizon_panel(t: StandIn) -> DataFrame:
    flow = features.broker_day_aggregates(t.B).join(features.cluster_features(t.B), ["dt", "ticker"], "left")
    px = audit.clean_panel(t.PD, horizons=(1, 3), lags=(1, 5), extremes=True)
    px = px.join(features.atr_pct(px), ["dt", "ticker"]).drop("open", "high", "low", "close", "volume")
    return flow.join(px, ["dt", "ticker"])


def _linear(t: StandIn) -> DataFrame:
    return walkforward.linear_walk_forward(features.price_features(t.P), "momentum_1d")


PRICE_F = ["momentum_1d", "volume_ratio"]
BROKER_F = FEATURES[:6]
MULTI_F = ["net_flow_total_roll5", "net_flow_total_roll10", "broker_concentration_roll5", "broker_concentration_roll10", "buy_days_5", "buy_days_10"]
SMART_F = ["smart_money_net", "retail_net", "absorber_net", "tod_divergence", "tod_signal", "absorber_vs_retail"]
#: Sets of features whose walk-forward scores are compared.
SETS = {
    "price": PRICE_F,
    "broker": BROKER_F,
    "full": BROKER_F + PRICE_F,
    "multi_day": MULTI_F,
    "multi_day_price": MULTI_F + PRICE_F,
    "all_days": BROKER_F + MULTI_F + PRICE_F,
    "smart_money": SMART_F,
    "smart_money_price": SMART_F + PRICE_F,
    "everything": BROKER_F + SMART_F + PRICE_F,
}
CLUSTER_F = [*(f"cl_{k}" for k in CLUSTERS), "cl_foreign", "cl_max"]
SCAN_PRICE_F = ["momentum_1d", "momentum_5d", "volume_ratio", "atr_pct"]
SCAN_SETS = {"price": SCAN_PRICE_F, "broker": BROKER_F, "broker_cluster": BROKER_F + CLUSTER_F, "full": BROKER_F + CLUSTER_F + SCAN_PRICE_F}


def ablated(t: StandIn) -> DataFrame:
    keep = keeper(t.spark, "ablation")
    preds, problems = ablation.ablate(keep(features.ablation_panel(t.B, t.P)), SETS, {str(h): f"target_{h}" for h in features.HORIZONS})
    return ablation.ablation_scores(keep(preds), problems)


def scanned(t: StandIn) -> DataFrame:
    clean = audit.clean_panel(t.PD, horizons=features.HORIZONS, lags=(1, 5), extremes=True)
    targets = {f"{k}_{h}": f"{c}_{h}" for k, c in (("ret", "fwd"), ("max", "max")) for h in features.HORIZONS}
    keep = keeper(t.spark, "scan")
    preds, _ = ablation.ablate(keep(features.scan_panel(t.B, clean)), SCAN_SETS, targets, train_min=60, test_window=10, least_rows=100)
    return ablation.horizon_scores(keep(preds))


SMART = ["smart_money_net", "retail_net", "absorber_net", "tod_divergence"]


def flagged(t: StandIn) -> DataFrame:
    """The summary with flags of a screen, one of them missing where there is no score."""
    return t.M.select("dt", "ticker", (F.col("tval") >= 100).alias("is_liquid"), (F.col("clean_score") <= 1).alias("is_pinky"), F.col("is_unusual_volume").alias("is_crossing"))


def event_payloads(t: StandIn) -> DataFrame:
    """Typed fields of nested payloads: a day's events of a user with their order, types and counts."""
    e = t.table("events")
    one = F.struct("event_id", F.struct(F.col("event_type").alias("type"), "value").alias("item"))
    day = e.groupBy(F.col("ts").cast("date").alias("dt"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    d = day.agg(F.array_sort(F.collect_list(one)).alias("own"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"), F.count(F.when(F.col("event_type") == "view", 1)).alias("v"))
    items = F.transform("own", lambda x: x["item"])
    counts = F.map_filter(F.create_map(F.lit("purchase"), F.col("p"), F.lit("view"), F.col("v")), lambda _, n: n > 0)
    payload = F.struct(items.alias("events"), counts.alias("counts"))
    fields = {"first_type": ("$.events[0].type", "string"), "first_value": ("$.events[0].value", "double"), "third_type": ("$.events[2].type", "string"), "purchases": ("$.counts.purchase", "bigint"), "views": ("$.counts.view", "bigint"), "absent": ("$.counts.none", "bigint")}
    return variant_fields(nested_as_variant(d.select("dt", "ticker", payload.alias("payload"))), "payload", fields)


_WALKS: dict[tuple[str, str], DataFrame] = {}


def tree_walk(t: StandIn) -> DataFrame:
    """The scored rows of one boosted walk-forward, of which several queries are views; fitted once an application and folder."""
    at = (t.spark.sparkContext.applicationId, t.dir)
    if at not in _WALKS:
        keep = keeper(t.spark, "walk")
        panel = keep(features.training_panel(t.B, t.P).coalesce(8))
        _WALKS[at] = keep(walkforward.tree_walk_forward(panel, FEATURES, keep, contributions=True))
    return _WALKS[at]


def held_out(t: StandIn) -> DataFrame:
    return tree_walk(t).where(F.col("part") == 2)


def smoke(t: StandIn) -> DataFrame:
    keep = keeper(t.spark, "smoke")
    panel = keep(features.training_panel(t.B, t.P).coalesce(8))
    scored = keep(walkforward.tree_walk_forward(health.latest_slice(panel), FEATURES, keep))
    return health.model_smoke(walkforward.cycle_report(scored), scored.where(F.col("part") == 2), panel)


def tree_importance(t: StandIn) -> DataFrame:
    keep = keeper(t.spark, "importance")
    return walkforward.importance(keep(features.training_panel(t.B, t.P).coalesce(8)), FEATURES, keep)


QUERY: dict[str, Query] = {
    "broker_day_aggregates": lambda t: features.broker_day_aggregates(t.B),
    "broker_correlation_1d": lambda t: features.broker_correlation_1d(t.B),
    "price_features_target": lambda t: features.price_features(t.P),
    "price_features_blocks": lambda t: in_blocks(t.P, features.price_features, 5, 1, rows=16),
    "rolling_features_blocks": lambda t: in_blocks(features.broker_day_aggregates(t.B), features.rolling_features, 10, 0, rows=16),
    "training_panel": lambda t: features.training_panel(t.B, t.P),
    "multi_horizon_targets": lambda t: features.multi_horizon_targets(t.P),
    "rolling_broker_features": lambda t: features.rolling_features(features.broker_day_aggregates(t.B)),
    "smart_money_features": lambda t: features.smart_money_features(t.B),
    "cluster_features": lambda t: features.cluster_features(t.B),
    "atr_pct": lambda t: features.atr_pct(t.P),
    "limit_flags": lambda t: audit.limit_flags(t.P).select("dt", "ticker", "pct", "at_ara", "at_arb"),
    "audit_limit_violation": lambda t: audit.detect(t.PD).where("limit_violation").select("dt", "ticker"),
    "audit_cross_ticker_dup": lambda t: audit.detect(t.PD).where("cross_ticker_dup").select("dt", "ticker"),
    "audit_series_break": lambda t: audit.detect(t.PD).where("series_break").select("dt", "ticker"),
    "audit_suspects_reasons": lambda t: audit.detect(t.PD).where("suspect").select("dt", "ticker", "reasons"),
    "audit_by_ticker": lambda t: audit.suspects_by_ticker(audit.detect(t.PD)),
    "audit_by_detector": lambda t: audit.suspects_by_detector(audit.detect(t.PD)),
    "collision_groups": lambda t: audit.collision_groups(audit.detect(t.PD)).select("dt", "tickers", "n"),
    "clean_prices": lambda t: audit.clean_prices(t.PD).select("dt", "ticker", "close"),
    "suspect_broker_rows": lambda t: audit.suspect_flow_rows(t.B, audit.detect(t.PD)).groupBy("ticker").agg(F.count("*").alias("n")),
    "gap_guarded_forward": lambda t: guarded(t, horizons=features.HORIZONS),
    "gap_guarded_lagged": lambda t: guarded(t, horizons=(), lags=(1, 5)),
    "gap_guarded_extremes": lambda t: guarded(t, horizons=(3,), extremes=True),
    "horizon_panel": horizon_panel,
    "repair_prices": lambda t: audit.repair_prices(t.PD, fixes(t)).select("dt", "ticker", "open", "close"),
    "rescale_netval": lambda t: audit.rescale_netval(backfilled(t), t.PD, fixes(t)).select("dt", "ticker", "broker_code", "netval"),
    "signal_outcomes": lambda t: signals.signal_outcomes(t.M, t.G),
    "signal_by_source": lambda t: signals.signal_by_source(signals.signal_outcomes(t.M, t.G)),
    "control_group": lambda t: metrics.summarise(signals.control_outcomes(t.M, t.G), ["h"]),
    "uncovered_signals": lambda t: signals.uncovered_signals(t.M.where("clean_score is not null"), t.G).select("flag_date", "ticker"),
    "konglo_watch": lambda t: signals.konglo_watch(t.M, t.G),
    "konglo_watch_sharpe": lambda t: metrics.sharpe_returns(signals.konglo_watch(t.M, t.G).where("resolved"), "current_pct"),
    "signal_record": recorded,
    "top_akum": lambda t: signals.top_akum(t.M),
    "retail_net_sell_top3": lambda t: signals.retail_net_sells(t.B),
    "dashboard_top5": lambda t: signals.dashboard_top(t.M.withColumn("ticker", F.expr("case when length(ticker) > 2 then 'UX' else translate(ticker, '0123456789', 'ABCDEFGHIJ') end")).groupBy("dt", "ticker").agg(*[F.max(c).alias(c) for c in LISTS]), LISTS),
    "bag_holders": lambda t: signals.bag_holders(inventory(t)),
    "tp_sl_trades": lambda t: simulate.tp_sl_trades(t.P, 3, 0.05, 0.03),
    "limit_aware_trades": lambda t: simulate.limit_aware_trades(t.P),
    "limit_aware_report": lambda t: simulate.limit_report(simulate.limit_aware_trades(t.P)),
    "strategy_grid": lambda t: simulate.strategy_grid(preds(t).select("dt", "ticker", "pred"), t.P),
    "strategy_winner": lambda t: simulate.grid_winner(simulate.strategy_grid(preds(t).select("dt", "ticker", "pred"), t.P)),
    "search_holdout_split": lambda t: simulate.search_holdout(t.P).groupBy("part").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.countDistinct("dt").alias("n_dates")),
    "walk_forward_folds": lambda t: walkforward.folds(date_spine(t.P)),
    "walk_forward_linear": _linear,
    "walk_forward_mae": lambda t: metrics.mae_vs_naive(_linear(t), cycle="cycle"),
    "chronological_split": lambda t: walkforward.chronological_split(t.P.select("dt", "ticker")),
    "sharpe_trigger": lambda t: metrics.sharpe_trigger(preds(t)),
    "sharpe_returns": lambda t: metrics.sharpe_returns(preds(t).where("pred > 0.005"), "actual"),
    "kelly": lambda t: metrics.kelly_from_trades(preds(t).where("pred > 0.005"), "actual"),
    "mae_vs_naive": lambda t: metrics.mae_vs_naive(preds(t)),
    "spearman_ic": lambda t: metrics.spearman_ic(preds(t)),
    "top_decile_edge": lambda t: metrics.top_decile_edge(preds(t)),
    "drawdown_quantiles": lambda t: metrics.drawdown_quantiles(guarded(t, horizons=(3,), extremes=True), "mdd_3"),
    "welch_test_stats": lambda t: metrics.welch_test(features.smart_money_panel(t.B, t.P), "tod_signal", "target"),
    "target_shape": lambda t: metrics.target_shape(features.price_features(t.P), "target"),
    "zscore_normalise": lambda t: metrics.normalise(features.price_features(t.P).select("dt", "ticker", "momentum_1d", "volume_ratio"), features.price_features(t.P).where("dt < date '1995-01-01'"), ["momentum_1d", "volume_ratio"]),
    "cross_source_offset": lambda t: health.cross_source(t.MS, t.M),
    "coverage_regression": lambda t: health.coverage(t.M, COVERED),
    "freshness": lambda t: health.freshness({"prices": t.P, "summary": t.M, "flow": t.B}, "2024-02-01"),
    "value_sanity": lambda t: health.value_sanity(t.M.withColumn("volume", F.when(F.col("m_dn_0") < -40, -1.0).otherwise(1.0))).select("dt", "ticker"),
    "capture_shape": lambda t: health.capture_shape(t.M),
    "signals_measurable": lambda t: health.signals_measurable(t.M.where("clean_score is not null"), t.G),
    "signal_projection": lambda t: health.signal_projection(t.G, t.M, "2024-02-01", "2024-03-01"),
    "new_contamination": lambda t: health.new_contamination(t.PD, audit.detect(t.PD).where("suspect and dt < date '1998-06-01'").select("dt", "ticker"), days=12),
    "panel_invariants": lambda t: health.panel_invariants(features.training_panel(t.B, t.P), ["broker_concentration", "net_buy_ratio", "broker_correlation_1d", "momentum_1d", "volume_ratio"]),
    "backfill_progress": lambda t: signals.backfill_progress(t.B, target=80),
    "backfill_netval": lambda t: signals.backfill_netval(cumulated(t), t.P, until="1996-12-31"),
    "latest_wins_upsert": lambda t: latest_wins([t.P, t.PD.where("month(dt) = 6")], ["dt", "ticker"]).select("dt", "ticker", "close"),
    "parse_scalars": literals,
    "feature_correlation": lambda t: metrics.feature_correlation(features.training_panel(t.B, t.P), ["broker_concentration", "net_flow_total", "n_brokers", "net_buy_ratio", "momentum_1d", "volume_ratio"]),
    "feature_ablation": ablated,
    "horizon_walk_forward": scanned,
    "top_drivers": lambda t: metrics.top_drivers(features.smart_money_features(t.B), SMART, 2).select("dt", "ticker", "drivers"),
    "liquid_screen": lambda t: signals.liquid_screen(flagged(t)).select("dt", "ticker"),
    "cross_source_verdict": lambda t: health.cross_source_verdict(t.MS, t.M),
    "cross_source_worst": lambda t: health.cross_source_worst(t.MS, t.M).select("dt", "ticker", "differs"),
    "capture_verdict": lambda t: health.capture_verdict(t.M, ["close", "high", "clean_score", "market_cap_t"], t.G, "2024-02-01", "2024-03-01"),
    "cross_source_skipped": lambda t: health.cross_source_verdict(t.MS.where("ticker = 'U3' and dt < date '2024-01-09'"), t.M),
    "cleaned_codes": lambda t: t.P.select("dt", "ticker", S.clean_code("ticker").alias("code"), S.shift_date("dt", 3).alias("three_days_before")),
    "failed_runs": lambda t: t.M.groupBy("dt").agg(F.count(F.when(F.col("clean_score").isNull() | (F.col("clean_score") <= 1), 1)).alias("failed"), F.count("*").alias("total")).withColumn("fails", S.should_fail_run("failed", "total")),
    "policy_rollout": lambda t: policy.rollout(actions(t)),
    "event_payloads": event_payloads,
    "gbt_walk_forward": lambda t: held_out(t).select("cycle", "dt", "ticker", "pred", "actual"),
    "walk_forward_cycles": lambda t: walkforward.cycle_report(tree_walk(t)),
    "walk_forward_pooled": lambda t: metrics.sharpe_trigger(held_out(t)),
    "walk_forward_trades": lambda t: walkforward.trade_log(tree_walk(t), FEATURES).select("cycle", "dt", "ticker", "pred", "actual", F.posexplode("drivers").alias("place", "d")).select("cycle", "dt", "ticker", "pred", "actual", "place", "d.name", "d.value"),
    "permutation_importance": tree_importance,
    "model_smoke": smoke,
    "model_report": lambda t: reports.model_report(features.training_panel(t.B, t.P), held_out(t)),
    "variants_report": lambda t: reports.variants_report(simulate.strategy_grid(preds(t).select("dt", "ticker", "pred"), t.P)),
    "line_report": lambda t: reports.model_report(features.training_panel(t.B, t.P), _linear(t)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: lambda spark, sf_dir, f=f, n=10 if k in EXACT else 6: rounded(f(StandIn(spark, sf_dir)), n) for k, f in QUERY.items()}
