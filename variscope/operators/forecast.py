"""Rolling-origin backtest of simple forecasts, for many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions.values import array_mad, array_percentile, ratio

# The models in the order that breaks ties, with the history each needs.
MODELS = {"naive_last": 1, "rolling_median_3": 3, "rolling_median_6": 6, "seasonal_naive_12": 12}
MINIMUM_TRAIN = 6
MINIMUM_FOLDS = 4
WEAK_WAPE, HIGH_BIAS = 0.3, 0.1
SEASONAL_HISTORY = 18


def _forecasts(value: str, series: Sequence[str], order: str, ahead: bool = False) -> dict[str, Column]:
    """What each model says about the current period, or (``ahead``) about the one after it."""
    w = W.partitionBy(*series).orderBy(order)
    last = 0 if ahead else -1

    def median(size: int) -> Column:
        frame = w.rowsBetween(last - size + 1, last)
        return F.when(F.count(value).over(frame) == size, F.percentile(value, F.lit(0.5)).over(frame))

    return {
        "naive_last": F.col(value) if ahead else F.lag(value, 1).over(w),
        "rolling_median_3": median(3),
        "rolling_median_6": median(6),
        "seasonal_naive_12": F.lag(value, 11 if ahead else 12).over(w),
    }


def fold_predictions(
    df: DataFrame, value: str, order: str, series: Sequence[str] = (), minimum_train: int = MINIMUM_TRAIN
) -> DataFrame:
    """One row per series, period and model: forecast, error and absolute error of each fold."""
    minimum_train = max(3, minimum_train)
    models = _forecasts(value, series, order)
    index = F.row_number().over(W.partitionBy(*series).orderBy(order)) - 1
    wide = (
        df.filter(F.col(value).isNotNull())
        .select(*series, order, F.col(value).alias("actual"), index.alias("_index"), *[
            c.alias(m) for m, c in models.items()
        ])
        .filter(F.col("_index") >= minimum_train)
        .drop("_index")
    )
    return (
        wide.unpivot([*series, order, "actual"], list(models), "model", "forecast")
        .filter(F.col("forecast").isNotNull())
        .withColumn("error", F.col("forecast") - F.col("actual"))
        .withColumn("absolute_error", F.abs("error"))
    )


def model_scores(folds: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """MAE, WAPE, bias and residual scale of each model. The errors kept per model are one per
    period of one series."""
    return (
        folds.groupBy(*series, "model")
        .agg(
            F.count("*").alias("folds"),
            F.avg("absolute_error").alias("mae"),
            ratio(F.sum("absolute_error"), F.sum(F.abs("actual"))).alias("wape"),
            ratio(F.sum("error"), F.sum(F.abs("actual"))).alias("bias"),
            F.collect_list("error").alias("_errors"),
        )
        .withColumns(
            {
                "residual_scale": array_mad(F.col("_errors")) * 1.4826,
                "p10": array_percentile(F.col("_errors"), 0.1),
                "p90": array_percentile(F.col("_errors"), 0.9),
                "eligible": F.col("folds") >= MINIMUM_FOLDS,
            }
        )
        .drop("_errors")
    )


def forecast_backtest(
    df: DataFrame, value: str, order: str, series: Sequence[str] = (), minimum_train: int = MINIMUM_TRAIN
) -> DataFrame:
    """One row per series: champion model, its scores, the next forecast and its 80 % interval."""
    minimum_train = max(3, minimum_train)
    rank = F.coalesce(*[F.when(F.col("model") == m, i) for i, m in enumerate(MODELS)])
    best = F.struct(F.col("wape"), rank.alias("order"), "model", "folds", "mae", "bias", "p10", "p90")
    scores = model_scores(fold_predictions(df, value, order, series, minimum_train), series)
    champion = scores.groupBy(*series).agg(
        F.min(F.when(F.col("eligible") & F.col("wape").isNotNull(), best)).alias("_best")
    )
    newest = F.row_number().over(W.partitionBy(*series).orderBy(F.desc(order)))
    history = F.count("*").over(W.partitionBy(*series))
    ahead = _forecasts(value, series, order, ahead=True)
    state = (
        df.filter(F.col(value).isNotNull())
        .select(*series, newest.alias("_newest"), history.alias("history_periods"), *[
            c.alias(m) for m, c in ahead.items()
        ])
        .filter(F.col("_newest") == 1)
        .drop("_newest")
    )
    if series:
        joined = state.join(champion, list(series), "left")
    else:
        joined = state.withColumn("_k", F.lit(1)).join(champion.withColumn("_k", F.lit(1)), "_k", "left")
    next_forecast = F.coalesce(*[F.when(F.col("_best.model") == m, F.col(m)) for m in MODELS])
    short = F.col("history_periods") < minimum_train + 4
    watch = short | (F.col("_best.wape") > WEAK_WAPE) | (F.abs("_best.bias") > HIGH_BIAS)
    return joined.select(
        *series,
        F.col("_best.model").alias("champion"),
        F.col("_best.wape").alias("wape"),
        F.col("_best.bias").alias("bias"),
        F.col("_best.mae").alias("mae"),
        next_forecast.alias("next_forecast"),
        (next_forecast - F.col("_best.p90")).alias("interval_lower"),
        (next_forecast - F.col("_best.p10")).alias("interval_upper"),
        "history_periods",
        F.coalesce(F.col("_best.folds"), F.lit(0)).alias("evaluated_periods"),
        F.when(F.col("_best").isNull(), "insufficient").when(watch, "watch").otherwise("ready").alias("status"),
    )
