"""Mixing sources to target weights with a low-discrepancy schedule.

Targets come from water-filling over the sources' sizes. Every source is laid out as one stream of words in
shuffled order, repeated if its target asks for it, and cut into blocks of equal length. Golden-ratio points
map through the cumulative targets to sources and give the order of the mixture: the r-th slot of a source
takes the r-th block of its stream. Each prefix of the mixture so holds the sources in their shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variscope.llm.scratch import running_total, stored
from variscope.llm.words import SPACE_CLASS, word_count

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_REPEATS = 2
BLOCK_WORDS = 1024
#: Bits of a document's shuffled place that name its chunk of the stream; chunks are summed apart.
CHUNK_BITS = 8
SLOT_CHUNK = 65_536
#: Cells of the unit interval that tell which sources a point may fall to.
CELLS = 1024
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, sid, source_size, target for a table of one row a source with its ``source_size``.

    Sources take the weights in turn, by code point, null last. The target is weight x level but at most
    ``most_repeats`` x size; the level spends the budget. In the order of the level at which sources are
    full, the level is the highest of what the remaining budget gives to the remaining weights. The windows
    see one row a source.
    """
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    one = sizes.select("source", "source_size", turn.alias("sid")).withColumn("_w", F.get(table, F.col("sid") % len(weights))).withColumn("_cap", F.col("source_size") * float(most_repeats))
    everything = Window.partitionBy(F.lit(0))
    filling = everything.orderBy(F.col("_cap") / F.col("_w"), "sid")
    full = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * (budget_percent / 100)
    levels = one.withColumn("_level", (budget - full) / rest)
    level = F.max("_level").over(everything)
    return levels.select("source", "sid", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def schedule(wanted: DataFrame, slots: int) -> DataFrame:
    """``slot``, ``sid``, ``block``: the order in which sources give their blocks.

    ``wanted`` has sid and words. Points fall to sources by an equi-join on cells of the unit interval.
    """
    total = F.sum("words").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("sid"))
    shares = wanted.filter("words > 0").select("sid", ((upto - F.col("words")) / total).alias("low"), (upto / total).alias("high"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spread = shares.select("sid", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    cells = spread.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("high", "sid"))).alias("_sources"))
    points = wanted.sparkSession.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", cell(F.col("u"))).withColumn("_chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    hit = F.coalesce(F.get(F.filter("_sources", lambda x: x["high"] > F.col("u")), F.lit(0)), F.element_at("_sources", -1))
    placed = points.join(cells, "cell").select("slot", "_chunk", hit["sid"].alias("sid"))
    return running_total(placed, ["sid"], "_chunk", [F.col("slot")], F.lit(1), "block").select("slot", "sid", "block")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mixture as segments: which words of which document stand in which slot.

    ``docs`` is a stored table with ``source``, ``size`` (words, not null) and columns ``id`` and ``mark`` that
    order documents with equal hashes; all are carried along. Adds source_size, target, place (of the
    document in its stream; unique with sid), slot, pass, from_word, to_word. A document of which nothing is
    taken has one row with null slot and pass. Blocks beyond a source's last slot follow at the end of the
    mixture, so every source gives its target to the word. Rows equal in all columns may change places.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(sizes, weights, budget_percent, most_repeats).withColumn("words", F.round("target").cast("long")), "targets")
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    slots = aims.agg(F.coalesce(F.sum(blocks), F.lit(0)).alias("n")).first()["n"]
    named = docs.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shuffled = named.withColumn("_at", F.xxhash64(F.lit(seed), "id", "mark"))
    shuffled = shuffled.withColumn("_chunk", F.shiftrightunsigned("_at", 64 - CHUNK_BITS))
    laid = running_total(shuffled, ["sid"], "_chunk", [F.col("_at"), F.col("id"), F.col("mark"), F.col("size")], F.col("size"), "_start", "_number")
    # Each pass over the stream, then each block the document reaches into.
    begin = F.col("_pass") * F.col("source_size") + F.col("_start")
    end = F.least(begin + F.col("size"), F.col("words"))
    passes = F.filter(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda p: (p * F.col("source_size") + F.col("_start") < F.col("words")) & (F.col("size") > 0))
    runs = laid.withColumn("_passes", passes).withColumn("_pass", F.explode_outer("_passes")).withColumn("_begin", begin).withColumn("_end", end)
    reach = F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_end") - 1) / block_words))
    cut = runs.withColumn("block", F.explode_outer(F.when(F.col("_pass").isNotNull(), reach)))
    order = schedule(aims.select("sid", "words"), slots).withColumnRenamed("sid", "_sid").withColumnRenamed("block", "_block")
    placed = cut.join(order, (F.col("sid") == F.col("_sid")) & (F.col("block") == F.col("_block")), "left")
    low = F.greatest(F.col("_begin"), F.col("block") * block_words) - F.col("_begin")
    high = F.least(F.col("_end"), (F.col("block") + 1) * block_words) - F.col("_begin")
    return placed.select(
        *docs.columns,
        "source_size",
        "target",
        "sid",
        F.struct("_chunk", "_number").alias("place"),
        F.when(F.col("block").isNotNull(), F.coalesce("slot", slots + F.col("block"))).alias("slot"),
        F.col("_pass").alias("pass"),
        low.alias("from_word"),
        high.alias("to_word"),
    )


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow table that ``mix`` takes: id, mark, source, size (words; null text: 0)."""
    return stored(docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")


def words_between(text: Column, low: Column, high: Column) -> Column:
    """The part of a text from word ``low`` to before word ``high``, white space inside kept."""
    parts = F.split(text, f"(?<={SPACE_CLASS})(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike("^" + SPACE_CLASS), 1).otherwise(0)  # leading white space is a part of its own
    return F.array_join(F.slice(parts, low.cast("int") + lead + 1, (high - low).cast("int")), "")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mixture, a row for each pass that takes some of it, with the columns of ``docs``.

    Documents that a target cuts off keep the words that are taken; ``n_chars``, if there, follows. Extra
    columns stay. Documents without words are not in the mixture.
    """
    segments = mix(sized(docs, key, text, source), **options)
    row = ["id", "mark", "source", "size", "sid", "place", "pass"]
    spans = segments.filter("pass IS NOT NULL").groupBy(*row).agg(F.min("from_word").alias("_low"), F.max("to_word").alias("_high"))
    names = {"id": "_id", "mark": "_mark", "source": "_src"}
    same = Window.partitionBy("_id", "_mark", "_src")
    taken = spans.withColumnsRenamed(names).withColumn("_copy", F.dense_rank().over(same.orderBy("place"))).drop("place", "sid")
    # Rows alike in key, text and source are numbered on both sides.
    mine = ["__key", "__mark", "__src"]
    rows = docs.withColumn("__key", F.col(key)).withColumn("__mark", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("__src", F.col(source))
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*mine).orderBy(F.lit(0))))
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("__key", "_id"), ("__mark", "_mark"), ("__src", "_src"), ("__copy", "_copy"))]
    part = F.when((F.col("_low") == 0) & (F.col("_high") == F.col("size")), F.col(text)).otherwise(words_between(F.col(text), F.col("_low"), F.col("_high")))
    out = rows.join(taken, on).withColumn(text, part)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
