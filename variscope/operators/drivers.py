"""Beam search over the tree of predicates, and how stable and how redundant its dimensions are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log1p, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions.timeparse import date_of
from variscope.functions.values import any_of, canonical_category, clamp, finite_number, impact_direction, multiplier, quoted, ratio
from variscope.operators.attribution import CATEGORY_HALF_LIFE, FREE_CATEGORIES, MINIMUM_ROWS, MINIMUM_SUPPORT, SCORE_WEIGHTS, Population
from variscope.operators.cohort import Predicate
from variscope.session import shared_table

#: Paths a bigint of the membership mask can hold.
MASK_BITS = 62
#: Parts of the combined score of a dimension: how far instability and redundancy lower it at most.
STABILITY_WEIGHT, REDUNDANCY_WEIGHT = 0.5, 0.5


@dataclass(frozen=True)
class Path:
    """A combination of predicates that the search has kept."""

    predicates: tuple[Predicate, ...]
    count: int
    score: float
    bound: float


def _combination_score(impact: Column, support: Column, lift: Column) -> Column:
    return F.abs(impact) * F.sqrt(support) * F.log1p(lift)


def _mask(paths: Sequence[Path]) -> list[Column]:
    """Which paths a row lies on, a bit each."""
    words = []
    for start in range(0, len(paths), MASK_BITS):
        word = F.lit(0).cast("bigint")
        for i, path in enumerate(paths[start : start + MASK_BITS]):
            inside = F.lit(True)
            for d, v in path.predicates:
                inside = inside & (F.col(quoted(d)) == F.lit(v))
            word = word + F.when(inside, F.lit(1 << i)).otherwise(F.lit(0))
        words.append(word)
    return words


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("count", "_a", "_e", "_gross")]


def _row_sums() -> list[Column]:
    return [F.count("*").alias("count"), F.sum("actual").alias("_a"), F.sum("expected").alias("_e"), F.sum(F.abs("residual")).alias("_gross")]


def _extensions(pop: Population, paths: Sequence[Path], singles: Sequence[Predicate]) -> DataFrame:
    """Sums for every path (by number) and every single predicate that holds inside it: one aggregation.

    A row is read once, however many paths it lies on: it is summed by its mask of paths, and masks are
    opened into paths on the sums. Values without enough rows in the whole cohort are left out, as none of
    their combinations can have enough.
    """
    dims = list(dict.fromkeys(d for d, _ in singles))
    names = [f"_m{i}" for i in range(-(-len(paths) // MASK_BITS))]
    number = {p: i for i, p in enumerate(singles)}
    held = []
    for d in dims:
        pairs = [x for p in singles if p[0] == d for x in (F.lit(p[1]), F.lit(number[p]))]
        held.append(F.try_element_at(F.create_map(*pairs), F.col(quoted(d))))
    rows = pop.prepared.select(*[m.alias(n) for m, n in zip(_mask(paths), names, strict=True)], F.filter(F.array(*held), lambda x: x.isNotNull()).alias("_singles"), "actual", "expected", "residual")
    cells = rows.filter(any_of(F.col(n) != 0 for n in names)).withColumn("single", F.explode("_singles")).groupBy(*names, "single").agg(*_row_sums())
    on = F.array(*[F.when(F.getbit(F.col(f"_m{i // MASK_BITS}"), F.lit(i % MASK_BITS)) == 1, F.lit(i)) for i in range(len(paths))])
    opened = cells.withColumn("path", F.explode(F.filter(on, lambda x: x.isNotNull())))
    return opened.groupBy("path", "single").agg(*_sums())


def _measures(pop: Population) -> dict[str, Column]:
    """What the sums of a combination say, as in the search for interactions."""
    spec, stats = pop.spec, pop.stats
    n = max(stats["n"], 1)
    mean_abs = ((stats["abs_residual"] or 0.0) / n) or 1.0
    average = spec.aggregation == "average"
    per = F.col("count") if average else F.lit(1)
    residual = (F.col("_a") - F.col("_e")).cast("double")
    support = F.col("count") / F.lit(n)
    impact = residual / per * (support if average else F.lit(1.0)) * multiplier(spec.polarity)
    lift = F.abs(residual / F.col("count")) / F.lit(mean_abs)
    return {
        "support": support,
        "actual": F.col("_a").cast("double") / per,
        "expected": F.col("_e").cast("double") / per,
        "business_impact": impact,
        "lift": lift,
        "score": _combination_score(impact, support, lift),
        "gross": F.col("_gross").cast("double"),
    }


def beam_search(
    pop: Population,
    width: int = 20,
    depth: int = 3,
    k: int = 10,
    minimum_support: float | None = None,
    minimum_gain: float | None = None,
) -> DataFrame:
    """The ``k`` best combinations of up to ``depth`` predicates, found level by level.

    Each level extends the ``width`` best combinations of the level before by every predicate of another
    dimension. Combinations with fewer rows than ``minimum_support`` go, and so do redundant ones, which
    have as many rows as a combination they extend. A combination is not extended if a bound on what its
    extensions can score, from its rows, its gross movement and the least support, does not pass the k-th
    best score so far; that loses no result. With ``minimum_gain`` the search stops after a level whose best score does not pass the
    best one before by that share. With a beam that holds every combination the result is that of an
    exhaustive search.

    ``gain`` is the score less the best score of a kept combination that it extends. The frontier lives on
    the driver: at most ``width`` paths, and single predicates, of which a dimension has at most
    1 / MINIMUM_SUPPORT.
    """
    if width < 1 or depth < 1 or k < 1:
        raise ValueError("width, depth and k must be positive")
    least = pop.minimum_support if minimum_support is None else max(minimum_support, float(MINIMUM_ROWS), pop.stats["n"] * MINIMUM_SUPPORT)
    n = max(pop.stats["n"], 1)
    mean_abs = ((pop.stats["abs_residual"] or 0.0) / n) or 1.0
    spark = pop.prepared.sparkSession
    names = {"support": "double", "actual": "double", "expected": "double", "business_impact": "double", "lift": "double", "score": "double"}
    schema = "predicates array<struct<dimension: string, value: string>>, segment string, ways int, count long, " + ", ".join(f"{c} {t}" for c, t in names.items()) + ", gain double"
    found: list[tuple] = []

    def bound(gross: float, count: int) -> float:
        """No extension moves more than the gross movement of its rows, on fewer rows than the least support."""
        impact = gross / n if pop.spec.aggregation == "average" else gross
        return impact * sqrt(count / n) * log1p(gross / least / mean_abs)

    def segment(predicates: Sequence[Predicate]) -> str:
        return "|".join(sorted(f"{d}={v}" for d, v in predicates))

    def keep(rows, gains) -> list[Path]:
        """The best combinations of a level; they join the results and the next frontier."""
        best = sorted(rows, key=lambda r: (-r[1]["score"], segment(r[0])))[: max(width, k)]
        for predicates, r in best:
            ordered = sorted(predicates)
            found.append((ordered, segment(ordered), len(ordered), r["count"], *[r[c] for c in names], r["score"] - gains.get(tuple(ordered), 0.0)))
        return [Path(tuple(sorted(p)), r["count"], r["score"], bound(r["gross"], r["count"])) for p, r in best[:width]]

    dims = list(pop.spec.open_dimensions)
    if not dims or not pop.stats["n"]:
        return spark.createDataFrame([], schema)
    measures = _measures(pop)
    first = (
        pop.prepared.select("actual", "expected", "residual", *[quoted(d) for d in dims])
        .unpivot(["actual", "expected", "residual"], [quoted(d) for d in dims], "dimension", "value")
        .groupBy("dimension", "value")
        .agg(*_row_sums())
        .filter(F.col("count") >= least)
        .select("dimension", "value", "count", *[c.alias(name) for name, c in measures.items()])
        .collect()  # at most 1 / MINIMUM_SUPPORT values a dimension
    )
    singles = sorted((r["dimension"], r["value"]) for r in first)
    frontier = keep([([(r["dimension"], r["value"])], r) for r in first], {})
    for ways in range(2, depth + 1):
        kth = sorted((row[9] for row in found), reverse=True)[k - 1 : k]
        frontier = [p for p in frontier if not kth or p.bound >= kth[0]]
        if not frontier or not singles:
            break
        parts = F.array(*[F.array(*[F.lit(singles.index(x)) for x in p.predicates]) for p in frontier])
        taken = F.array(*[F.array(*[F.lit(dims.index(d)) for d, _ in p.predicates]) for p in frontier])
        dimension = F.array(*[F.lit(dims.index(d)) for d, _ in singles])
        counts, scores = F.array(*[F.lit(p.count) for p in frontier]), F.array(*[F.lit(p.score) for p in frontier])
        at = lambda a, i: F.element_at(a, F.col(i) + 1)
        grown = _extensions(pop, frontier, singles).filter((F.col("count") >= least) & ~F.array_contains(at(taken, "path"), at(dimension, "single")))
        # The same combination may come from several paths.
        combos = (
            grown.groupBy(F.array_sort(F.array_append(at(parts, "path"), F.col("single"))).alias("combo"))
            .agg(*[F.max(c).alias(c) for c in ("count", "_a", "_e", "_gross")], F.max(F.col("count") == at(counts, "path")).alias("redundant"), F.max(at(scores, "path")).alias("parent"))
            .filter("NOT redundant")
            .select("combo", "count", "parent", *[c.alias(name) for name, c in measures.items()])
            .orderBy(F.desc("score"), "combo")
            .limit(max(width, k))
            .collect()
        )
        before = max(p.score for p in frontier)
        rows = [([singles[i] for i in r["combo"]], r) for r in combos]
        frontier = keep(rows, {tuple(sorted(p)): r["parent"] for p, r in rows})
        if not frontier or minimum_gain is not None and frontier[0].score <= before * (1 + minimum_gain):
            break
    found.sort(key=lambda row: (-row[9], row[1]))
    return spark.createDataFrame(found[:k], schema).withColumn("impact_direction", impact_direction(F.col("business_impact")))


def _period_rows(pop: Population, grain: str) -> DataFrame:
    """The valid rows of a cohort with the start of their period."""
    spec, source = pop.spec, pop.filtered
    if spec.time_field is None:
        raise ValueError("stability needs the time field of the specification")
    measures = [finite_number(source, spec.actual).alias("actual")]
    if spec.expected is not None:
        measures.append(finite_number(source, spec.expected).alias("expected"))
    dims = [canonical_category(source, d).alias(d) for d in spec.open_dimensions]
    return pop.valid(source.select(*dims, *measures, F.date_trunc(grain, date_of(source, spec.time_field)).cast("date").alias("_period")))


def leave_one_out_scores(pop: Population, grain: str = "quarter") -> DataFrame:
    """The driver score of every dimension without the rows of one period: _period, dimension, score, rank.

    One scan makes the table of periods and categories; what remains without a period is the category's
    total less its cell. Rows without a date belong to no period and stay in all of them. The residual
    scale is that of the whole cohort. A null ``_period`` is the score with all rows.
    """
    spec = pop.spec
    dims = list(spec.open_dimensions)
    cells = (
        _period_rows(pop, grain)
        .unpivot(["_period", "actual", "expected", "residual"], [quoted(d) for d in dims], "dimension", "value")
        .groupBy("_period", "dimension", "value")
        .agg(*_row_sums())
    )
    cells = shared_table(cells, "period-cells")
    # One row a period: of the calendar, not of the data's size.
    periods = cells.filter(F.col("dimension") == dims[0]).groupBy("_period").agg(F.sum("count").alias("n"), F.sum("_gross").cast("double").alias("gross")).collect()
    n, gross = sum(r["n"] for r in periods), sum(r["gross"] for r in periods)
    without = [(None, n, gross)] + [(r["_period"], n - r["n"], gross - r["gross"]) for r in periods if r["_period"] is not None]
    listed = F.array(*[F.struct(F.lit(p).cast("date").alias("period"), F.lit(rows).cast("bigint").alias("n"), F.lit(g).alias("gross")) for p, rows, g in without])
    totals = cells.groupBy("dimension", "value").agg(
        *[F.sum(c).alias(c) for c in ("count", "_a", "_e")],
        # As many entries as there are periods.
        F.map_from_entries(F.collect_list(F.when(F.col("_period").isNotNull(), F.struct("_period", F.struct("count", "_a", "_e").alias("cell"))))).alias("_cells"),
    )
    left = totals.withColumn("_out", F.explode(listed)).withColumn("_cell", F.when(F.col("_out.period").isNotNull(), F.try_element_at("_cells", F.col("_out.period"))))
    zero = F.lit(0)
    count = F.col("count") - F.coalesce(F.col("_cell.count"), zero)
    residual = (F.col("_a") - F.col("_e")) - F.coalesce(F.col("_cell._a") - F.col("_cell._e"), zero)
    average = spec.aggregation == "average"
    shaped = left.select(F.col("_out.period").alias("_period"), F.col("_out.n").alias("n"), F.col("_out.gross").alias("gross"), "dimension", "value", count.alias("count"), residual.cast("double").alias("residual")).filter("count > 0")
    support = F.col("count") / F.col("n")
    standardized = F.abs(F.col("residual") / F.col("count")) / F.greatest(F.lit(float(pop.scale)), F.lit(1e-9))
    shaped = shaped.select(
        "_period", "n", "gross", "dimension", "value", "count",
        F.abs(F.col("residual") / F.col("n") if average else F.col("residual")).alias("size"),
        (F.least(F.lit(1.0), standardized / 3) * F.least(F.lit(1.0), F.sqrt(support / 0.05))).alias("surprise"),
    )
    return _ranked_scores(shaped, average)


def _ranked_scores(shaped: DataFrame, average: bool) -> DataFrame:
    """Scores by the same rule as ``score_dimensions``, for each period left out."""
    keys = ["_period", "dimension"]
    supported = F.col("count") >= F.greatest(F.lit(float(MINIMUM_ROWS)), F.col("n") * MINIMUM_SUPPORT)
    parts = shaped.groupBy(*keys).agg(
        F.count("*").alias("distinct_count"),
        F.max("n").alias("n"),
        F.max("gross").alias("gross"),
        F.sum("size").alias("grouped"),
        F.sum(F.col("surprise") * F.col("size")).alias("surprised"),
        F.coalesce(F.sum(F.when(supported, F.col("size"))), F.lit(0.0)).alias("supported"),
    )
    # The rank filter goes below the shuffle: three rows a task, period and dimension.
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("size"), "value"))
    top = shaped.select(*keys, "size", first.alias("_rank")).filter("_rank <= 3").groupBy(*keys).agg(F.sum("size").alias("top3"))
    top = top.select(F.col("_period").alias("_p"), F.col("dimension").alias("_d"), "top3")
    both = parts.join(top, F.col("_period").eqNullSafe(F.col("_p")) & (F.col("dimension") == F.col("_d"))).filter("distinct_count > 1")
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("grouped")), F.lit(0.0))
    row_gross = F.coalesce(F.nullif(F.col("gross") / F.col("n") if average else F.col("gross"), F.lit(0.0)), F.lit(1.0))
    weighed = {"impact": F.least(F.lit(1.0), F.col("grouped") / row_gross), "surprise": share("surprised"), "concentration": share("top3"), "support_quality": share("supported")}
    penalty = 1 / (1 + F.greatest(F.lit(0), F.col("distinct_count") - FREE_CATEGORIES) / CATEGORY_HALF_LIFE)
    score = clamp(100 * sum((weighed[c] * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0)) * penalty)
    scored = both.select(*keys, score.alias("score"))
    # One row for each dimension of the specification.
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("_period").orderBy(F.desc(F.round("score", 9)), "dimension")))


def stability(pop: Population, grain: str = "quarter") -> DataFrame:
    """How little each dimension's score and rank depend on any one period.

    ``rank_agreement`` is one less the mean move of the rank over the periods left out, as a share of the
    greatest move; ``stability`` lowers it by the spread of the scores around their mean.
    """
    scored = leave_one_out_scores(pop, grain)
    by_dimension = scored.groupBy("dimension").agg(
        F.max(F.when(F.col("_period").isNull(), F.col("score"))).alias("score"),
        F.max(F.when(F.col("_period").isNull(), F.col("rank"))).alias("rank"),
        F.collect_list(F.when(F.col("_period").isNotNull(), F.struct("score", "rank"))).alias("_left"),
    )
    dims = max(len(pop.spec.open_dimensions) - 1, 1)
    left = F.transform("_left", lambda x: x["score"])
    count = F.size("_left")
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    moved = add(F.col("_left"), lambda x: F.abs(x["rank"] - F.col("rank")).cast("double"))
    some = by_dimension.filter("score IS NOT NULL").withColumns(
        {
            "periods": count,
            "mean_score": F.when(count > 0, add(left, lambda x: x) / count),
            "lowest_score": F.array_min(left),
            "highest_score": F.array_max(left),
            "rank_agreement": F.when(count > 0, 1 - moved / (count * dims)),
        }
    )
    spread = F.sqrt(add(left, lambda x: (x - F.col("mean_score")) * (x - F.col("mean_score"))) / count)
    some = some.withColumn("score_spread", F.when(count > 0, spread))
    steady = 1 - F.least(F.lit(1.0), F.coalesce(ratio(F.col("score_spread"), F.col("mean_score")), F.lit(0.0)))
    return some.select("dimension", "score", "rank", "periods", "mean_score", "lowest_score", "highest_score", "score_spread", "rank_agreement", (F.col("rank_agreement") * steady).alias("stability"))


def redundancy(pop: Population, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Normalised mutual information of every two dimensions: first, second, mutual_information, entropies, nmi and determines.

    Rows become distinct tuples of all dimensions with a count in one scan; every dimension and every pair
    is a grouping of the same tuples, and the sums of n ln n over its groups give all entropies. ``nmi`` is
    the information over the geometric mean of the two entropies; ``determines`` over the smaller one: at 1
    one dimension says all of the other. Both are 0 if a dimension has one category only.
    """
    dims = list(dimensions or pop.spec.open_dimensions)
    tuples = pop.prepared.groupBy(*[quoted(d) for d in dims]).agg(F.count("*").alias("n"))
    groups = [(i, i) for i in range(len(dims))] + [(i, j) for i in range(len(dims)) for j in range(i + 1, len(dims))]
    none = F.lit(None).cast("string")
    parts = F.array(*[F.struct(F.lit(i * len(dims) + j).alias("g"), F.col(quoted(dims[i])).alias("x"), (none if i == j else F.col(quoted(dims[j]))).alias("y")) for i, j in groups])
    counted = tuples.select("n", F.explode(parts).alias("p")).groupBy("p.g", "p.x", "p.y").agg(F.sum("n").alias("n"))
    entropy = F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    # One row of as many entropies as there are dimensions and pairs.
    known = counted.groupBy("g").agg(entropy.alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("g", "h"))).alias("h"))
    pairs = F.array(*[F.struct(F.lit(dims[i]).alias("first"), F.lit(dims[j]).alias("second"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in groups if i != j])
    h = lambda g: F.try_element_at("h", g)
    rows = known.select("h", F.explode(pairs if len(dims) > 1 else F.array().cast("array<struct<first: string, second: string, i: int, j: int>>")).alias("p")).select(
        "p.first", "p.second", h(F.col("p.i") * (len(dims) + 1)).alias("first_entropy"), h(F.col("p.j") * (len(dims) + 1)).alias("second_entropy"), h(F.col("p.i") * len(dims) + F.col("p.j")).alias("_joint")
    )
    tiny = lambda c: F.when(F.abs(c) < 1e-12, F.lit(0.0)).otherwise(c)
    rows = rows.filter(F.col("_joint").isNotNull()).withColumn("mutual_information", tiny(F.col("first_entropy") + F.col("second_entropy") - F.col("_joint")))
    of = lambda c: clamp(F.coalesce(ratio(F.col("mutual_information"), tiny(c)), F.lit(0.0)), 0.0, 1.0)
    return rows.withColumns({"nmi": of(F.sqrt(F.col("first_entropy") * F.col("second_entropy"))), "determines": of(F.least("first_entropy", "second_entropy"))}).drop("_joint")


def landscape(contributions: DataFrame, scores: DataFrame, steady: DataFrame, redundant: DataFrame, stability_weight: float = STABILITY_WEIGHT, redundancy_weight: float = REDUNDANCY_WEIGHT) -> DataFrame:
    """Every dimension that was looked at, by a combined score: its driver score lowered for instability and for redundancy.

    The redundancy of a dimension is its greatest ``nmi`` with a dimension of a higher driver score; the best
    one has none. ``unfavorable_impact`` and ``favorable_offset`` are its categories' movements of either sign.
    """
    sides = contributions.groupBy("dimension").agg(
        F.sum(F.least(F.lit(0.0), F.col("business_impact"))).alias("unfavorable_impact"), F.sum(F.greatest(F.lit(0.0), F.col("business_impact"))).alias("favorable_offset")
    )
    # One row for each dimension of the specification, or pair of them, from here on.
    order = scores.select("dimension", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "dimension")).alias("_at"))
    one, two = (order.select(F.col("dimension").alias(f"_{side}"), F.col("_at").alias(f"_at_{side}")) for side in ("first", "second"))
    placed = redundant.join(one, F.col("first") == F.col("_first")).join(two, F.col("second") == F.col("_second"))
    later = F.when(F.col("_at_first") > F.col("_at_second"), F.col("first")).otherwise(F.col("second"))
    worst = placed.groupBy(later.alias("dimension")).agg(F.max("nmi").alias("redundancy"))
    joined = scores.join(sides, "dimension").join(steady.select("dimension", "stability"), "dimension", "left").join(worst, "dimension", "left")
    held = F.coalesce("stability", F.lit(0.0))
    like = F.coalesce("redundancy", F.lit(0.0))
    combined = F.col("score") * (1 - stability_weight * (1 - held)) * (1 - redundancy_weight * like)
    rows = joined.select("dimension", "score", "unfavorable_impact", "favorable_offset", "surprise", "support_quality", held.alias("stability"), like.alias("redundancy"), combined.alias("combined_score"))
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("combined_score", 9)), "dimension")))
