"""Hierarchies: level paths and edges, parent tables, depth and cycles, node insight."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variscope.functions.values import BLANKS, all_of, impact_direction, ratio, trimmed
from variscope.session import ensure_checkpoint_dir

# Texts that mean "no value", and the column names each role may have, best first.
MISSING_TOKENS = ("", "(missing)", "(null)", "null", "undefined")
COLUMN_ALIASES = {
    "node_id": ("node_id", "nodeid", "node_key", "member_id", "hierarchy_node_id"),
    "parent_id": ("parent_node_id", "parentnodeid", "parent_id", "parent_key", "hierarchy_parent_id"),
    "label": ("node_label", "node_name", "member_name", "label", "name"),
    "level": ("hierarchy_level", "level_number", "node_level", "level"),
    "actual": ("actual_value", "actual", "value", "amount"),
    "plan": ("plan_value", "plan", "budget", "target", "expected"),
}


def hierarchy_value(c: Column) -> Column:
    text = F.coalesce(trimmed(c.cast("string")), F.lit(""))
    return F.when(~F.lower(text).isin(list(MISSING_TOKENS)), text)


def valid_levels(levels: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Distinct, available levels."""
    return [c for c in dict.fromkeys(x.strip() for x in levels) if c in columns]


def encoded(c: Column) -> Column:
    """A part of a path with everything escaped but letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def level_paths(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct level values with their row counts: everything below works on these."""
    return (
        df.select(*[hierarchy_value(F.col(c)).alias(c) for c in levels])
        .groupBy(*levels)
        .agg(F.count("*").alias("rows"))
    )


def hierarchy_path(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Leading levels up to the first gap, as escaped ``field=value`` text, with depth and rows."""
    levels = valid_levels(levels, df.columns)
    steps = [
        F.when(all_of(F.col(x).isNotNull() for x in levels[: i + 1]), F.concat(encoded(F.lit(c)), F.lit("="), encoded(F.col(c))))
        for i, c in enumerate(levels)
    ]
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return (
        level_paths(df, levels)
        .select(
            F.when(F.size(path) > 0, F.array_join(path, "&")).otherwise("root").alias("path"),
            F.size(path).alias("depth"),
            "rows",
        )
        .groupBy("path", "depth")
        .agg(F.sum("rows").alias("rows"))
    )


def hierarchy_edges(df: DataFrame, levels: Sequence[str], root: str = "All data") -> DataFrame:
    """Unique parent-child edges of the level paths, root edges first."""
    levels = valid_levels(levels, df.columns)
    edges = []
    for i, c in enumerate(levels):
        edges.append(
            F.when(
                all_of(F.col(x).isNotNull() for x in levels[: i + 1]),
                F.struct(
                    F.lit(i + 1).alias("depth"),
                    F.lit("__root__" if i == 0 else levels[i - 1]).alias("parent_field"),
                    (F.lit(root) if i == 0 else F.col(levels[i - 1])).alias("hierarchy_parent"),
                    F.lit(c).alias("child_field"),
                    F.col(c).alias("hierarchy_child"),
                ),
            )
        )
    return (
        level_paths(df, levels)
        .select(F.inline(F.filter(F.array(*edges), lambda x: x.isNotNull())))
        .distinct()
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.distinct().orderBy("depth", "hierarchy_parent", "hierarchy_child")


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    """Role of each column by its name; ``node_id`` and ``parent_id`` are required."""
    by_name = {re.sub(r"[\s.-]+", "_", c.strip().lower()): c for c in columns}
    found = {
        role: by_name[next(a for a in aliases if a in by_name)]
        for role, aliases in COLUMN_ALIASES.items()
        if any(a in by_name for a in aliases)
    }
    lacking = [r for r in ("node_id", "parent_id") if r not in found]
    if lacking:
        raise ValueError(f"a hierarchy needs the columns {lacking}")
    return found


def _number(c: Column) -> Column:
    """A finite number without currency, percent and thousands signs, else null."""
    found = F.regexp_replace(c.cast("string"), r"[$,%\s]", "").try_cast("double")
    return F.when(F.abs(found) < float("inf"), found)


def hierarchy_normalize(df: DataFrame, row_idx: str) -> DataFrame:
    """One row per node: summed measures, the first parent, label and level by row order."""
    cols = resolve_columns(df.columns)
    none = F.lit(None)
    text = lambda role: (
        F.nullif(F.btrim(F.col(cols[role]).cast("string"), F.lit(BLANKS)), F.lit("")) if role in cols else none.cast("string")
    )
    level = F.greatest(F.lit(1), F.round(_number(F.col(cols["level"]))).cast("int")) if "level" in cols else none.cast("int")
    rows = df.select(
        text("node_id").alias("node_id"),
        text("parent_id").alias("_parent"),
        text("label").alias("_label"),
        level.alias("_level"),
        (_number(F.col(cols["actual"])) if "actual" in cols else F.lit(0.0)).alias("_actual"),
        (_number(F.col(cols["plan"])) if "plan" in cols else none.cast("double")).alias("_plan"),
        F.col(row_idx).alias("_idx"),
    ).filter(F.col("node_id").isNotNull())
    first = F.min_by(F.struct("_parent", "_label", "_level"), "_idx").alias("_first")
    folded = rows.groupBy("node_id").agg(
        first,
        F.sum(F.coalesce("_actual", F.lit(0.0))).alias("actual"),
        F.sum("_plan").alias("plan"),
        F.count("*").alias("row_count"),
    )
    return folded.select(
        "node_id",
        F.col("_first._parent").alias("parent_id"),
        F.coalesce("_first._label", "node_id").alias("label"),
        F.col("_first._level").alias("level"),
        "actual",
        "plan",
        (F.col("actual") - F.col("plan")).alias("variance"),
        "row_count",
    )


def hierarchy_parent_check(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent does not exist, or is the node itself."""
    own = nodes.filter(F.col("parent_id") == F.col("node_id")).select(
        "node_id", "parent_id", F.lit("self_parent").alias("issue")
    )
    known = nodes.select(F.col("node_id").alias("parent_id"))
    orphans = (
        nodes.filter(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("node_id")))
        .join(known, "parent_id", "left_anti")
        .select("node_id", "parent_id", F.lit("orphan").alias("issue"))
    )
    return own.unionByName(orphans)


def hierarchy_depth(nodes: DataFrame) -> DataFrame:
    """Depth and root of every node (roots have depth 1); ``cycle`` marks nodes in or below a cycle.

    Pointers double in each round (a node's pointer becomes its pointer's pointer), so a tree of
    depth d takes about log2(d) joins. Nodes that reached their root leave the join, which keeps
    the shared root out of it as a hot key. Each round is checkpointed to the shared folder. While
    an open node still leads to a root, every round closes at least one node of its chain, so a
    round that closes none leaves exactly the nodes in or below a cycle.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    known = nodes.select(F.col("node_id").alias("_known"))
    linked = nodes.join(known, F.col("parent_id") == F.col("_known"), "left").select(
        "node_id",
        F.when(F.col("_known") != F.col("node_id"), F.col("_known")).alias("ptr"),
        F.coalesce(F.col("parent_id") == F.col("node_id"), F.lit(False)).alias("self_parent"),
        (F.col("parent_id").isNotNull() & F.col("_known").isNull()).alias("orphan"),
    )
    state = linked.select(
        "*",
        F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(F.col("ptr").isNull(), F.col("node_id")).alias("root"),
    ).checkpoint()
    open_nodes, before = state.filter("ptr IS NOT NULL").count(), None
    while open_nodes and open_nodes != before:
        ahead = state.select(
            F.col("node_id").alias("ptr"),
            F.col("ptr").alias("_ptr"),
            F.col("steps").alias("_steps"),
            F.col("root").alias("_root"),
        )
        moved = (
            state.filter("ptr IS NOT NULL")
            .join(ahead, "ptr")
            .select(
                "node_id",
                F.col("_ptr").alias("ptr"),
                "self_parent",
                "orphan",
                (F.col("steps") + F.col("_steps")).alias("steps"),
                F.col("_root").alias("root"),
            )
        )
        state = state.filter("ptr IS NULL").unionByName(moved).checkpoint()
        before, open_nodes = open_nodes, state.filter("ptr IS NOT NULL").count()
    cycle = F.col("ptr").isNotNull()
    return state.select(
        "node_id",
        F.when(~cycle, F.col("steps") + 1).alias("depth"),
        "root",
        "orphan",
        "self_parent",
        cycle.alias("cycle"),
    )


def hierarchy_cycles(depths: DataFrame) -> DataFrame:
    """Structure totals: roots, deepest level, orphans, self-parents and nodes tied to a cycle."""
    return depths.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("depth") == 1).alias("roots"),
        F.max("depth").alias("max_depth"),
        F.count_if("orphan").alias("orphans"),
        F.count_if("self_parent").alias("self_parents"),
        F.count_if("cycle").alias("cycle_nodes"),
    ).withColumn("valid", F.expr("orphans = 0 AND self_parents = 0 AND cycle_nodes = 0 AND roots > 0"))


def node_insight(nodes: DataFrame) -> DataFrame:
    """Share of the parent, impact, direction and confidence of nodes with ``amount``, ``expected``,
    ``transactions`` and ``parent_amount`` (each may be null)."""
    impact = F.col("amount") - F.col("expected")
    share = ratio(F.col("amount"), F.abs("parent_amount"))
    return nodes.withColumns(
        {
            "share_of_parent": share,
            "business_impact": impact,
            "direction": F.coalesce(impact_direction(impact), F.lit("unknown")),
            "confidence": F.when((F.col("transactions") >= 100) | (F.abs(share) >= 0.2), "high")
            .when((F.col("transactions") >= 20) | share.isNotNull(), "medium")
            .otherwise("low"),
        }
    )
