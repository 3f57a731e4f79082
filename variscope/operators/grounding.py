"""Questions and answers: intents, tool plans, evidence lookup and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions import words
from variscope.functions.values import any_of

#: Characters of the windows that index digit runs for tokens of this length and more.
WINDOW = 8


def intent_tag(question: Column) -> Column:
    """The first intent whose pattern occurs in the question, else ``unknown``."""
    q = F.lower(question)
    found = F.coalesce(*[F.when(q.rlike(pattern), F.lit(name)) for name, pattern in words.INTENTS])
    return F.coalesce(found, F.lit("unknown"))


def tool_plan(question: Column) -> Column:
    """Tools to run for a question, in order."""
    q = F.lower(question)
    found = F.filter(
        F.array(*[F.when(q.rlike(pattern), F.lit(name)) for name, pattern in words.TOOL_PATTERNS]),
        lambda x: x.isNotNull(),
    )
    general = F.array(*[F.lit(t) for t in words.GENERAL_TOOLS])
    return F.concat(
        F.array(*[F.lit(t) for t in words.BASE_TOOLS]), F.when(F.size(found) > 0, found).otherwise(general)
    )


def evidence_for_kinds(evidence: DataFrame, by: str = "tool") -> DataFrame:
    """Evidence rows each tool (or ``intent``) may cite, the first few of each run in ledger order."""
    table = words.TOOL_KINDS if by == "tool" else words.INTENT_KINDS
    allowed = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(k) for k in kinds]).alias("kinds")) for n, kinds in table.items()]),
        lambda x: F.array_contains(x["kinds"], F.col("kind")),
    )
    items = F.lit(words.WIDE_TOOL_ITEMS) if by == "intent" else F.when(
        F.col(by) == "scan_dimensions", words.WIDE_TOOL_ITEMS
    ).otherwise(words.TOOL_ITEMS)
    order = W.partitionBy("run_id", by).orderBy("seq", "evidence_id")
    return (
        evidence.withColumn(by, F.explode(F.transform(allowed, lambda x: x["name"])))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= words.WIDE_TOOL_ITEMS)
        .filter(F.col("rank") <= items)
    )


def unknown_evidence(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims that cite evidence the ledger does not hold."""
    return claims.join(ledger.select("run_id", "evidence_id"), ["run_id", "evidence_id"], "left_anti")


def number_tokens(text: Column) -> Column:
    """Numeric tokens of a text, without currency signs and thousands separators."""
    found = F.regexp_extract_all(text, F.lit(words.NUMBER_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"[$,]", ""))))


def _windows(run: Column, sizes: Column) -> Column:
    """The substrings of a digit run of the wanted sizes, with their places, in one pass for each size."""

    def of(n: int) -> Column:
        found = F.regexp_extract_all(run, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
        return F.when(F.array_contains(sizes, n), F.transform(found, lambda w, i: F.struct(w.alias("window"), (i + 1).alias("at"))))

    none = F.array().cast("array<struct<window: string, at: int>>")
    return F.concat(*[F.coalesce(of(n), none) for n in range(1, WINDOW + 1)])


def first_seen(tokens: DataFrame, evidence: DataFrame) -> DataFrame:
    """The earliest position at which the evidence of a run contains each of its tokens: run_id, token, _seen.

    The digit runs of the evidence are indexed by windows: of each token length up to ``WINDOW``, and of
    ``WINDOW`` characters for all longer tokens together, so a digit run gives a row for each of its windows
    however many token lengths there are. A longer token is cut into windows that cover it; it occurs where
    all of them stand in one digit run at their distances.
    """
    wanted = tokens.select("run_id", "token").distinct()
    sizes = wanted.groupBy("run_id").agg(F.collect_set(F.least(F.length("token"), F.lit(WINDOW))).alias("_sizes"))
    runs = (
        evidence.select(
            "run_id",
            "position",
            F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(words.NUMBER_RUN), F.lit(0)))).alias("_run"),
        )
        .groupBy("run_id", "_run")
        .agg(F.min("position").alias("position"))
    )
    # A run without tokens needs no evidence.
    windows = runs.join(sizes, "run_id").select("run_id", "position", F.md5("_run").alias("_of"), F.explode(_windows(F.col("_run"), F.col("_sizes"))).alias("_w"))
    windows = windows.select("run_id", "position", "_of", "_w.window", "_w.at")
    short = wanted.filter(F.length("token") <= WINDOW)
    whole = windows.groupBy("run_id", F.col("window").alias("token")).agg(F.min("position").alias("_seen"))
    whole = whole.join(short, ["run_id", "token"], "left_semi")
    # Long tokens travel by their digest.
    long = wanted.filter(F.length("token") > WINDOW).withColumn("_id", F.md5("token"))
    piece = lambda w, at: F.struct(at.cast("int").alias("offset"), w.alias("window"))
    whole_ones = F.transform(F.regexp_extract_all("token", F.lit(f".{{{WINDOW}}}"), F.lit(0)), lambda w, i: piece(w, i * WINDOW))
    last = F.array(piece(F.right("token", F.lit(WINDOW)), F.length("token") - WINDOW))
    pieces = F.when(F.length("token") % WINDOW == 0, whole_ones).otherwise(F.concat(whole_ones, last))
    parts = long.select("run_id", "_id", F.size(pieces).alias("_parts"), F.explode(pieces).alias("p")).select("run_id", "_id", "_parts", "p.offset", "p.window")
    met = parts.join(windows, ["run_id", "window"]).groupBy("run_id", "_id", "_of", (F.col("at") - F.col("offset")).alias("_begin"))
    pieced = met.agg(F.count("*").alias("_n"), F.max("_parts").alias("_parts"), F.min("position").alias("position")).filter("_n = _parts")
    found = pieced.groupBy("run_id", "_id").agg(F.min("position").alias("_seen"))
    return whole.unionByName(found.join(long, ["run_id", "_id"]).select("run_id", "token", "_seen"))


def grounding_check(answers: DataFrame, evidence: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Four checks of each answer against the evidence of its run that comes before it.

    ``claims`` is the result of ``claim_check`` for these answers: with it the check of references asks that
    every claim cites evidence and all of it is known, without it that the run has earlier evidence.

    ``answers`` has ``run_id, answer_id, position, answer, calculation_run_id`` and ``evidence`` has
    ``run_id, position, kind, text``. A numeric token is grounded when some earlier evidence text of
    the run contains it. Evidence is reduced to windows of its digit runs and joined on (run, window), so no
    run is ever gathered in one place and no pair of texts is compared.
    """
    tokens = answers.select("run_id", "answer_id", "position", F.explode(number_tokens(F.col("answer"))).alias("token"))
    unsupported = (
        tokens.join(first_seen(tokens, evidence), ["run_id", "token"], "left")
        .groupBy("run_id", "answer_id")
        .agg(
            F.count("*").alias("numeric_tokens"),
            F.count_if(F.col("_seen").isNull() | (F.col("_seen") >= F.col("position"))).alias("unsupported_numbers"),
        )
    )
    begins = evidence.groupBy("run_id").agg(
        F.min("position").alias("_first"),
        F.min(F.when(F.col("kind") == "external-context", F.col("position"))).alias("_external"),
    )
    # Texts are judged where they are; only the verdict travels.
    causal = any_of(F.col("answer").rlike(f"(?i){p}") for p in words.CAUSAL_PATTERNS)
    judged = answers.select("run_id", "answer_id", "position", "calculation_run_id", causal.alias("_causal"))
    checked = (
        judged.join(unsupported, ["run_id", "answer_id"], "left")
        .join(begins, "run_id", "left")
        .na.fill(0, ["numeric_tokens", "unsupported_numbers"])
        .withColumns(
            {
                "evidence_references": F.coalesce(F.col("_first") < F.col("position"), F.lit(False)),
                "causality_guardrail": ~(
                    F.coalesce(F.col("_external") < F.col("position"), F.lit(False)) & F.col("_causal")
                ),
                "numeric_grounding": F.col("unsupported_numbers") == 0,
                "run_linkage": F.col("calculation_run_id").eqNullSafe(F.col("run_id")),
            }
        )
    )
    if claims is not None:
        grounded = claims.select("run_id", "answer_id", "claims_grounded")
        checked = checked.drop("evidence_references").join(grounded, ["run_id", "answer_id"], "left").withColumn("evidence_references", F.coalesce("claims_grounded", F.lit(False)))
    names = ["evidence_references", "causality_guardrail", "numeric_grounding", "run_linkage"]
    passed = sum((F.col(c).cast("int") for c in names), F.lit(0))
    return checked.select(
        "run_id",
        "answer_id",
        "numeric_tokens",
        "unsupported_numbers",
        *names,
        F.round(passed / len(names) * 100).cast("int").alias("score"),
        (passed == len(names)).alias("passed"),
    )
