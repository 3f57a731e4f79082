"""The evidence ledger of a run: typed rows with stable ids and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variscope.operators.cohort import CohortSpec

# How many drivers and combinations become evidence.
TOP_DRIVERS, TOP_SEGMENTS = 8, 5
#: Days before a period in which an article may have to do with it.
LEAD_DAYS = 30
KINDS = (
    "dataset", "metric-definition", "scope", "variance", "time-series", "forecast-model", "driver",
    "interaction", "quality", "external-context", "limitation",
)


def item(df: DataFrame, kind: str, run_id: str, key: Column, title: Column, summary: Column, source: str = "deterministic-calculation", seq: Column | None = None) -> DataFrame:
    """Rows of one kind; the payload is the whole row as JSON."""
    place = F.lit(KINDS.index(kind) * 1000)
    return df.select(
        (place if seq is None else place + seq).cast("int").alias("seq"),
        F.concat_ws(":", F.lit(kind), F.lit(run_id), key).alias("evidence_id"),
        F.lit(kind).alias("kind"),
        title.cast("string").alias("title"),
        summary.cast("string").alias("summary"),
        F.lit(source).alias("source"),
        F.lit(run_id).alias("run_id"),
        F.to_json(F.struct("*")).alias("payload"),
    )


def scope_evidence(scope: DataFrame, spec: CohortSpec, run_id: str) -> DataFrame:
    cohort = " · ".join(f"{d}={v}" for d, v in spec.predicates) or "All selected rows"
    return item(scope, "scope", run_id, F.lit("scope"), F.lit("Investigation scope"), F.lit(cohort)).unionByName(
        item(
            scope, "variance", run_id, F.lit("variance"), F.lit("Selected-scope variance"),
            F.format_string("%.2f %s; actual %.2f versus comparison %.2f", F.abs("business_impact"), "impact_direction", "actual", "expected"),
        )
    )


def driver_evidence(scores: DataFrame, run_id: str) -> DataFrame:
    """The leading category of each of the eight best dimensions."""
    top = scores.orderBy(F.desc("score"), "dimension").limit(TOP_DRIVERS)
    key = F.concat_ws(":", "dimension", F.substring(F.sha2("top_category", 256), 1, 16))
    return item(
        top, "driver", run_id, key, F.concat_ws(": ", "dimension", "top_category"),
        F.format_string("%.2f impact; score %.0f", "top_category_impact", "score"),
        seq=F.row_number().over(Window.orderBy(F.desc("score"), "dimension")),  # of eight rows at most
    )


def interaction_evidence(interactions: DataFrame, run_id: str) -> DataFrame:
    top = interactions.orderBy(F.desc("score"), "segment").limit(TOP_SEGMENTS)
    return item(
        top, "interaction", run_id, F.substring(F.sha2("segment", 256), 1, 16), F.col("segment"),
        F.format_string("%.2f %s; %.1f%% support", F.abs("business_impact"), "impact_direction", F.col("support") * 100),
        seq=F.row_number().over(Window.orderBy(F.desc("score"), "segment")),  # of five rows at most
    )


def table_evidence(df: DataFrame, kind: str, run_id: str, key: str, title: str, summary: Column, source: str = "deterministic-calculation") -> DataFrame:
    """Evidence from any small result table, one item per row."""
    return item(df, kind, run_id, F.col(key).cast("string"), F.lit(title), summary, source)


def dataset_evidence(fingerprint: DataFrame, name: str, run_id: str) -> DataFrame:
    """The identity of the data, from its one-row fingerprint."""
    summary = F.format_string("%d rows; content hash %s", "row_count", "content_hash")
    return item(fingerprint, "dataset", run_id, F.substring("content_hash", 1, 16), F.lit(name), summary, "dataset-contract")


def external_evidence(articles: DataFrame, periods: DataFrame, run_id: str, series: str, lead_days: int = LEAD_DAYS) -> DataFrame:
    """Articles about the time of each materially changed period: hypotheses for context, not causal evidence.

    ``articles`` has row_idx, title and published_at (a day), ``periods`` the series with period_start and
    period_end. A period meets the articles from ``lead_days`` before it to its end, and is an item if there
    are any. Articles become one row a day first; days and periods meet in buckets of days as wide as a
    period with its lead may be, so a period is in a few buckets and a day in one.
    """
    daily = articles.dropna(subset=["published_at"]).groupBy(F.col("published_at").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.max(F.struct("row_idx", "title")).alias("last")
    )
    width = lead_days + 31
    bucket = lambda d: F.floor(F.unix_date(d) / width)
    first = F.date_sub("period_start", lead_days)
    wanted = periods.select(series, "period_start", "period_end", first.alias("_first")).distinct()
    wanted = wanted.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_first")), bucket(F.col("period_end")))))
    met = wanted.join(daily.withColumn("_bucket", bucket(F.col("day"))), "_bucket").filter("day BETWEEN _first AND period_end")
    about = met.groupBy(series, "period_start", "period_end").agg(F.sum("n").alias("articles"), F.max(F.struct("day", "last")).alias("_last"))
    about = about.select(series, "period_start", "period_end", "articles", F.col("_last.day").alias("latest_day"), F.col("_last.last.title").alias("latest_title"))
    key = F.concat_ws(":", F.col(series).cast("string"), F.col("period_start").cast("string"))
    summary = F.format_string("Untrusted hypothesis material: %d articles, the latest of %s", F.col("articles"), F.col("latest_day").cast("string"))
    return item(about, "external-context", run_id, key, F.lit("External context of a material period"), summary, "external-context")


def evidence_table(parts: list[DataFrame]) -> DataFrame:
    """All evidence of a run in ledger order columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims_of(contributions: DataFrame, run_id: str) -> DataFrame:
    """One claim per category, citing the driver evidence it would need."""
    key = F.concat_ws(":", F.lit("driver"), F.lit(run_id), "dimension", F.substring(F.sha2("value", 256), 1, 16))
    return contributions.select(
        F.lit(run_id).alias("run_id"), F.concat_ws("=", "dimension", "value").alias("claim_id"), key.alias("evidence_id")
    )
