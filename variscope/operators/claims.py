"""Whether the claims, tool traces and drill actions of answers refer to what they may refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A response: what it claims with which evidence, which evidence its tools gave, and which drills it offers.
RESPONSE = (
    "run_id string, answer_id string, claims array<struct<id: string, evidence_ids: array<string>>>, "
    "trace array<struct<tool: string, evidence_ids: array<string>>>, "
    "actions array<struct<dimension: string, predicates: array<struct<dimension: string, value: string>>>>"
)


def _reference(part: str, at: Column, name: Column, place: Column, what: str, ref: Column) -> Column:
    return F.struct(
        F.lit(part).alias("part"), at.cast("int").alias("at"), name.alias("name"), place.cast("int").alias("ref_at"), F.lit(what).alias("what"), ref.alias("ref")
    )


def _evidence(part: str, items: Column, name: str, keep_empty: bool) -> Column:
    """References of the evidence ids of claims or traces; with ``keep_empty`` an item without ids gives one null reference."""

    def of(x: Column, i: Column) -> Column:
        ids = F.coalesce(x["evidence_ids"], F.array().cast("array<string>"))
        found = F.transform(ids, lambda ref, j: _reference(part, i, x[name], j, "evidence", ref))
        empty = F.array(_reference(part, i, x[name], F.lit(None), "evidence", F.lit(None).cast("string")))
        return F.when(F.size(ids) == 0, empty).otherwise(found) if keep_empty else found

    return F.flatten(F.transform(items, of))


def _dimensions(actions: Column) -> Column:
    """References of the dimensions that drill actions and their predicates name; an action may name none of its own."""

    def of(x: Column, i: Column) -> Column:
        own = F.when(F.coalesce(x["dimension"], F.lit("")) != "", F.array(_reference("action", i, x["dimension"], F.lit(None), "dimension", x["dimension"])))
        inner = F.transform(F.coalesce(x["predicates"], F.array().cast("array<struct<dimension: string, value: string>>")), lambda p, j: _reference("predicate", i, p["dimension"], j, "dimension", p["dimension"]))
        return F.concat(F.coalesce(own, F.filter(inner, lambda _: F.lit(False))), inner)

    return F.flatten(F.transform(actions, of))


def references(responses: DataFrame) -> DataFrame:
    """Every reference of every response with its place: part, at, name, ref_at, what and ref.

    Lists may be null or empty. Only a claim must cite something: without evidence it has one null reference.
    """
    empty = {c: F.coalesce(F.col(c), F.array().cast(responses.schema[c].dataType)) for c in ("claims", "trace", "actions")}
    every = F.concat(_evidence("claim", empty["claims"], "id", True), _evidence("tool", empty["trace"], "tool", False), _dimensions(empty["actions"]))
    return responses.select("run_id", "answer_id", F.explode(every).alias("r")).select("run_id", "answer_id", "r.*")


def checked_references(responses: DataFrame, ledger: DataFrame, allowed: DataFrame) -> DataFrame:
    """The references with ``error``, null where they resolve.

    ``ledger`` has the citable ``run_id, evidence_id`` and ``allowed`` the ``run_id, dimension`` that a run may
    drill into. Both are reduced to distinct names and met in one outer join on (run, what, name).
    """
    known = ledger.select("run_id", F.lit("evidence").alias("what"), F.col("evidence_id").alias("ref")).unionByName(
        allowed.select("run_id", F.lit("dimension").alias("what"), F.col("dimension").alias("ref"))
    )
    found = references(responses).join(known.dropna().distinct().withColumn("_known", F.lit(True)), ["run_id", "what", "ref"], "left")
    error = (
        F.when(F.col("_known"), None)
        .when((F.col("part") == "claim") & F.col("ref_at").isNull(), "claim_without_evidence")
        .when(F.col("what") == "evidence", F.concat("part", F.lit("_unknown_evidence")))
        .otherwise(F.concat("part", F.lit("_disallowed_dimension")))
    )
    return found.select("run_id", "answer_id", "part", "at", "name", "ref_at", "ref", error.alias("error"))


def claim_errors(responses: DataFrame, ledger: DataFrame, allowed: DataFrame) -> DataFrame:
    """The references that do not resolve, each with its place in its response."""
    return checked_references(responses, ledger, allowed).filter("error IS NOT NULL")


def claim_check(responses: DataFrame, ledger: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row a response: claims, references, the errors of each kind, ``claims_grounded`` and ``valid``.

    ``claims_grounded`` says that every claim cites evidence and all of it is known; ``valid`` that traces and
    drills resolve as well. A response without claims, traces and actions is valid.
    """
    kinds = {
        "claims_without_evidence": "claim_without_evidence",
        "unknown_in_claims": "claim_unknown_evidence",
        "unknown_in_tools": "tool_unknown_evidence",
        "disallowed_in_actions": "action_disallowed_dimension",
        "disallowed_in_predicates": "predicate_disallowed_dimension",
    }
    counted = (
        checked_references(responses, ledger, allowed)
        .groupBy("run_id", "answer_id")
        .agg(F.count_if((F.col("part") != "claim") | F.col("ref_at").isNotNull()).alias("references"), *[F.count_if(F.coalesce(F.col("error") == e, F.lit(False))).alias(c) for c, e in kinds.items()])
    )
    sizes = responses.select("run_id", "answer_id", F.coalesce(F.size("claims"), F.lit(0)).alias("_claims")).withColumn("claims", F.greatest(F.lit(0), F.col("_claims"))).drop("_claims")
    counted = counted.withColumnsRenamed({"run_id": "_run", "answer_id": "_answer"})
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("answer_id").eqNullSafe(F.col("_answer"))
    out = sizes.join(counted, same, "left").drop("_run", "_answer").na.fill(0, ["references", *kinds])
    grounded = (F.col("claims_without_evidence") == 0) & (F.col("unknown_in_claims") == 0)
    others = (F.col("unknown_in_tools") == 0) & (F.col("disallowed_in_actions") == 0) & (F.col("disallowed_in_predicates") == 0)
    return out.withColumns({"claims_grounded": grounded, "valid": grounded & others})
