"""Articles: normalisation, tags, de-duplication, overlap with the data and why-factor scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from variscope.functions import words
from variscope.functions.values import BLANKS, any_of
from variscope.session import shared_table

TOP_TAGS, TOP_FACTORS, MAX_ARTICLES = 4, 8, 40
GRAM = 3
#: Words of the longest run a value is anchored at, and the mark of their first words in the bitmap.
RUN, FIRST = 4, "first"
#: Bits of the map of anchored runs (1 MB), in the rows that Spark's bitmap functions build.
ANCHOR_BITS, BITMAP_ROW = 1 << 23, 1 << 15
#: Tasks that share the occurrences of one anchored word.
SALTS = 8
#: A list is broadcast up to so many bytes (16 MB) and so many values without a whole word between two blanks.
LIST_BYTES, PART_VALUES = 1 << 24, 1024


def normalize_date(raw: Column) -> Column:
    """``YYYYMMDDhhmmss`` to a day, other texts with a space for the T; a zone at the end is kept, but for Z."""
    compact = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return (
        F.when(raw.rlike(r"^\d{14}$"), compact)
        .when(raw.isNotNull(), F.regexp_replace(F.regexp_replace(raw, r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(\.\d+)?Z$", "$1"))
        .otherwise("")
    )


def source_of(url: Column) -> Column:
    host = F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("news source"))


def articles_normalize(df: DataFrame) -> DataFrame:
    """Provider rows (``title``, ``url``, ``source``, ``published_raw``, ``snippet``, ``angle``) in one
    article shape. Rows without url drop out; a missing title becomes ``Untitled article``."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumns(
        {
            "title": F.coalesce(blank("title"), F.lit("Untitled article")),
            "source": F.coalesce(blank("source"), source_of(F.col("url"))),
            "published_at": normalize_date(F.col("published_raw")),
            "snippet": F.coalesce(blank("snippet"), blank("title"), F.lit("")),
        }
    ).filter(blank("url").isNotNull()).drop("published_raw")


def hits(text: Column, vocabulary: Sequence[str]) -> Column:
    """How many of the words occur anywhere in a lower-case text."""
    return sum((text.contains(w).cast("int") for w in vocabulary), F.lit(0))


def sentiment_tag(low: Column) -> Column:
    """Tone of a lower-case text."""
    good, bad = hits(low, words.POSITIVE_WORDS), hits(low, words.NEGATIVE_WORDS)
    return F.when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")


def topic_tags(low: Column) -> Column:
    """Topics of a lower-case text."""
    tags = F.array(
        *[F.when(any_of(low.contains(w) for w in terms), F.lit(t)) for t, terms in words.TOPICS.items()]
    )
    return F.filter(tags, lambda x: x.isNotNull())


def decorate(articles: DataFrame) -> DataFrame:
    """Add ``sentiment`` and ``tags`` from title and snippet."""
    low = F.col("_low")
    return (
        articles.withColumn("_low", F.lower(F.concat_ws(" ", "title", "snippet")))
        .withColumns({"sentiment": sentiment_tag(low), "tags": topic_tags(low)})
        .drop("_low")
    )


def dedupe_keep_first(articles: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """The first article per url, or per lower-case title where the url is blank.

    Only keys and row numbers are grouped (with partial aggregation, so a key with a third of all
    copies sends one row per task); the texts move once, spread evenly by row number.
    """
    key = F.coalesce(F.nullif("url", F.lit("")), F.lower("title"))
    first = articles.groupBy(key.alias("_key")).agg(F.min(row_idx).alias(row_idx))
    return articles.join(first.select(row_idx), row_idx, "left_semi")


def union_all(active: DataFrame, passive: DataFrame, cap: int | None = None) -> DataFrame:
    """Both searches without repeats: the active rows first, each search in row order.

    Row numbers are unique within a search, not across both. ``cap`` limits a report to its first rows.
    """
    both = active.withColumn("_search", F.lit(0)).unionByName(passive.withColumn("_search", F.lit(1)))
    key = F.coalesce(F.nullif("url", F.lit("")), F.lower("title"))
    first = both.groupBy(key.alias("_key")).agg(F.min(F.struct("_search", "row_idx")).alias("_first")).select("_first.*")
    ordered = both.join(first, ["_search", "row_idx"], "left_semi").orderBy("_search", "row_idx").drop("_search")
    return ordered if cap is None else ordered.limit(cap)


def article_summary(articles: DataFrame) -> DataFrame:
    """Counts by angle and sentiment, the tone and the four most frequent tags."""
    counts = (
        articles.select("angle", "sentiment", F.size("tags").alias("_size"), F.explode_outer("tags").alias("tag"))
        .groupBy("angle", "sentiment", "tag", "_size")
        .agg(F.count("*").alias("_n"))
    )
    # An article appears once per tag: weigh it by 1 / number of tags to count articles.
    weight = F.col("_n") / F.greatest(F.col("_size"), F.lit(1))
    count = lambda c: F.round(F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))).cast("bigint")
    totals = counts.agg(
        count(F.col("angle") == "active").alias("active_count"),
        count(F.col("angle") == "passive").alias("passive_count"),
        count(F.col("sentiment") == "positive").alias("positives"),
        count(F.col("sentiment") == "negative").alias("negatives"),
    )
    tags = (
        counts.filter("tag IS NOT NULL")
        .groupBy("tag")
        .agg(F.sum("_n").alias("n"))
        .agg(
            # One entry per topic.
            F.array_join(
                F.slice(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))), lambda s: s["tag"]
                    ),
                    1,
                    TOP_TAGS,
                ),
                ", ",
            ).alias("top_tags")
        )
        .scalar()
    )
    tone = (
        F.when(F.col("negatives") > F.col("positives"), "risk-heavy")
        .when(F.col("positives") > F.col("negatives"), "opportunity-leaning")
        .otherwise("mixed/neutral")
    )
    return totals.withColumns({"tone": tone, "top_tags": tags})


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def timing_overlap(articles: DataFrame, rows: DataFrame, time_field: str) -> DataFrame:
    """Articles published in a month the data has. There are no more distinct months than the
    calendar has, so they are broadcast and no text is shuffled."""
    months = rows.select(month_key(F.col(time_field)).alias("month")).distinct()
    dated = articles.withColumn("month", month_key(F.col("published_at")))
    return dated.join(F.broadcast(months), "month", "left_semi")


def _anchors(listed: DataFrame) -> DataFrame:
    """Words of each value that any text with the value must hold, and how they sit there.

    A word between two blanks of the value is a whole word of the text (``word``). Without one, a word
    before a blank ends a word of the text (``suffix``), one after a blank begins it (``prefix``), and a
    value without blanks lies inside one word, known by any of its ``GRAM`` characters in a row (``gram``).
    """
    parts = F.split("_low", r"\s+")
    size = F.size(parts)
    named = lambda k, c: F.struct(F.lit(k).alias("_kind"), c.alias("_anchor"))
    inner = F.transform(F.filter(parts, lambda w, i: (i > 0) & (i < size - 1) & (w != "")), lambda w: named("word", w))
    outer = F.filter(F.array(named("suffix", F.element_at(parts, 1)), named("prefix", F.element_at(parts, -1))), lambda x: x["_anchor"] != "")
    only = F.element_at(parts, 1)
    n = F.least(F.length(only), F.lit(GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.length(only) - n + 1), lambda i: named("gram", F.substr(only, i, n)))
    every = F.when(F.size(inner) > 0, inner).when(size > 1, outer).otherwise(grams)
    return listed.withColumn("_a", F.explode(F.array_distinct(every))).select("value", "_low", "_a.*")


def _word_keys(vocabulary: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every key under which a word of a text may be anchored; only lengths in use are made."""
    sizes = anchors.agg(
        F.struct(
            *[
                F.collect_set(F.when(F.col("_kind") == k, F.length("_anchor"))).alias(k)
                for k in ("suffix", "prefix", "gram")
            ]
        )
    ).scalar()
    size = F.length("_word")
    fits = lambda k: F.filter(F.col("_sizes")[k], lambda n: n <= size)
    key = lambda k, c: F.struct(F.lit(k).alias("_kind"), c.alias("_anchor"))
    keys = F.concat(
        F.array(key("word", F.col("_word"))),
        F.transform(fits("suffix"), lambda n: key("suffix", F.substr("_word", size - n + 1, n))),
        F.transform(fits("prefix"), lambda n: key("prefix", F.substr("_word", F.lit(1), n))),
        F.flatten(
            F.transform(
                fits("gram"),
                lambda n: F.array_distinct(
                    F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: key("gram", F.substr("_word", i, n)))
                ),
            )
        ),
    )
    return vocabulary.withColumn("_sizes", sizes).select("_word", "_n", F.inline(keys))


def _anchored(vocabulary: DataFrame, listed: DataFrame) -> DataFrame:
    """What a text must hold for each value to be looked for there: ``_shape`` and ``_run``, with the pieces of the
    text that the value may cover before and after the place (``_before``, ``_after``).

    A value of at most ``GRAM`` characters without blanks is known by itself (``gram``), a longer one without
    blanks by the words of the texts that contain it (``word``), one of two parts by the words that end or begin
    with its rarer part (``suffix``, ``prefix``), and any other by a run of up to ``RUN`` whole words with its
    rarest one (``run1`` to ``run4``). A value with an anchor that no text has is in no text.
    """
    parts = F.split("_low", r"\s+")
    itself = (F.size(parts) == 1) & (F.length("_low") <= GRAM)
    shaped = lambda df, shape, run, before, after: df.select(
        shape.alias("_shape"), run.alias("_run"), before.cast("int").alias("_before"), after.cast("int").alias("_after"), "value", "_low"
    )
    none = F.lit(0)
    short = shaped(listed.filter(itself), F.lit("gram"), F.col("_low"), none, none)
    anchors = _anchors(listed.filter(~itself))
    keys = _word_keys(vocabulary, anchors).join(anchors.select("_kind", "_anchor").distinct(), ["_kind", "_anchor"])
    counts = keys.groupBy("_kind", "_anchor").agg(F.sum("_n").alias("_count"))
    found = anchors.join(counts, ["_kind", "_anchor"], "left")
    rank = F.struct(F.coalesce("_count", F.lit(0)).alias("n"), F.col("_kind").alias("kind"), F.col("_anchor").alias("anchor"))
    rarest = found.groupBy("value", "_low").agg(F.min(rank).alias("_best")).filter("_best.n > 0")
    chosen = rarest.select("value", "_low", F.col("_best.kind").alias("_kind"), F.col("_best.anchor").alias("_anchor"))
    inner = F.slice(parts, 2, F.greatest(none, F.size(parts) - 2))
    whole = chosen.filter("_kind = 'word'").withColumn("_inner", inner).withColumn("_size", F.least(F.size("_inner"), F.lit(RUN)))
    start = F.least(F.array_position("_inner", F.col("_anchor")).cast("int"), F.size("_inner") - F.col("_size") + 1)
    whole = whole.withColumn("_start", start)
    run = F.array_join(F.slice("_inner", F.col("_start"), F.col("_size")), " ")
    runs = shaped(whole, F.concat(F.lit("run"), F.col("_size")), run, 2 * F.col("_start"), 2 * (F.size(parts) - 1 - F.col("_start")))
    spelled = chosen.filter("_kind <> 'word'").join(keys.drop("_n"), ["_kind", "_anchor"])
    spelled = spelled.filter((F.col("_kind") != "gram") | F.contains("_word", "_low"))
    shape = F.when(F.col("_kind") == "gram", "word").otherwise(F.col("_kind"))
    words_ = shaped(spelled, shape, F.col("_word"), F.when(F.col("_kind") == "prefix", 2).otherwise(0), F.when(F.col("_kind") == "suffix", 2).otherwise(0))
    return short.unionByName(runs).unionByName(words_).distinct()


def _bit_of(shape: Column, run: Column) -> Column:
    return F.pmod(F.xxhash64(shape, run), F.lit(ANCHOR_BITS))


def _bits(anchored: DataFrame) -> Column:
    """The anchored runs, and the words they begin with, as a bitmap of fixed size in rows of Spark's bitmap functions."""
    first = anchored.filter("_shape NOT IN ('gram', 'word')").select(F.lit(FIRST).alias("_shape"), F.substring_index("_run", " ", 1).alias("_run"))
    every = anchored.select("_shape", "_run").unionByName(first)
    at = every.select(_bit_of(F.col("_shape"), F.col("_run")).alias("h")).select(F.floor(F.col("h") / BITMAP_ROW).alias("row"), (F.col("h") % BITMAP_ROW).alias("bit"))
    rows = at.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    known = rows.agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("known"))
    numbers = F.sequence(F.lit(0), F.lit(ANCHOR_BITS // BITMAP_ROW - 1))
    return known.select(F.transform(numbers, lambda i: F.try_element_at("known", i.cast("bigint")))).scalar()


def _may_be_anchored(shape: str, run: Column, bits: Column) -> Column:
    h = _bit_of(F.lit(shape), run)
    row = F.get(bits, F.floor(h / BITMAP_ROW).cast("int"))
    at = h % BITMAP_ROW
    byte = F.conv(F.hex(F.substr(row, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _runs_met(lowered: DataFrame, key: str, spans: Sequence[Row], bits: Column) -> DataFrame:
    """The places of the texts where a run, or a word with a part of a value, may stand, each with as much of the
    text as the values of its shape may cover."""
    pieces = F.regexp_extract_all("_text", F.lit(r"\S+|\s+"), F.lit(0))
    # The bitmap is a column of the row, so that it is not built again for every word.
    known = lowered.select(key, pieces.alias("_pieces"), bits.alias("_bits"))
    first = F.when(F.get("_pieces", F.lit(0)).rlike(r"^\s"), 2).otherwise(1)
    places = F.when(F.size("_pieces") >= first, F.sequence(first, F.size("_pieces"), F.lit(2)))

    def met(i: Column) -> Column:
        word = lambda k: F.get("_pieces", i - 1 + 2 * k)
        options = []
        for s in spans:
            words_ = int(s["_shape"][3:]) if s["_shape"].startswith("run") else 1
            run = F.concat_ws(" ", *[word(k) for k in range(words_)])
            start = F.greatest(F.lit(1), i - s["before"])
            around = F.array_join(F.slice("_pieces", start, i + s["after"] - start + 1), "")
            found = F.struct(F.lit(s["_shape"]).alias("_shape"), run.alias("_run"), around.alias("_around"))
            options.append(F.when(_may_be_anchored(s["_shape"], run, F.col("_bits")), found))
        # Most words begin no run: one look tells.
        kept = F.when(_may_be_anchored(FIRST, word(0), F.col("_bits")), F.filter(F.array(*options), lambda x: x.isNotNull()))
        return F.coalesce(kept, F.array().cast("array<struct<_shape: string, _run: string, _around: string>>"))

    return known.select(key, F.inline(F.flatten(F.transform(places, met))))


def _spelled_met(lowered: DataFrame, key: str, shape: str, bits: Column) -> DataFrame:
    """The distinct words, or ``GRAM`` and fewer characters in a row, of the texts that values may be known by."""
    if shape == "word":
        every = F.split("_text", r"\s+")
    else:
        every = F.flatten(F.array(*[F.regexp_extract_all("_text", F.lit(rf"(?=(\S{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]))
    # Filtered as an array: the bitmap would follow every exploded row.
    known = lowered.select(key, F.array_distinct(every).alias("_every"), bits.alias("_bits"))
    kept = F.filter("_every", lambda x: _may_be_anchored(shape, x, F.col("_bits")))
    return known.select(key, F.explode(kept).alias("_run")).select(key, F.lit(shape).alias("_shape"), "_run", F.lit(None).cast("string").alias("_around"))


def _whole_words(low: Column) -> Column:
    """The words between two blanks of a value, which are whole words of every text that contains it."""
    parts = F.split(low, r"\s+")
    return F.filter(parts, lambda w, i: (i > 0) & (i < F.size(parts) - 1) & (w != ""))


def _words_met(spoken: DataFrame, listed: DataFrame) -> DataFrame:
    """The word of a text at which each value is looked for (``_word``): its rarest whole word, or the empty one, that
    every text counts as having, for a value without whole words. A value with a word that no text has is in no text."""
    inner = listed.withColumn("_inner", F.array_distinct(_whole_words(F.col("_low"))))
    anchors = inner.select("value", "_low", F.explode("_inner").alias("_word"))
    counts = spoken.join(F.broadcast(anchors.select("_word").distinct()), "_word").groupBy("_word").agg(F.count("*").alias("_count"))
    rank = F.struct(F.coalesce("_count", F.lit(0)).alias("n"), F.col("_word").alias("word"))
    rarest = anchors.join(counts, "_word", "left").groupBy("value", "_low").agg(F.min(rank).alias("_best")).filter("_best.n > 0")
    whole = rarest.select(F.col("_best.word").alias("_word"), "value", "_low")
    return whole.unionByName(inner.filter(F.size("_inner") == 0).select(F.lit("").alias("_word"), "value", "_low"))


def _mentions_in_place(texts: DataFrame, text: str, key: str, listed: DataFrame) -> DataFrame:
    """The mentions of a list that can be broadcast. Each distinct word of a text meets the values looked for there,
    and the text is searched where it is, in generated code: only pairs that were found are shuffled."""
    lowered = texts.select(key, F.lower(text).alias("_lowered"))
    spoken = lowered.select(F.explode(F.split("_lowered", r"\s+")).alias("_word"))
    anchored = shared_table(_words_met(spoken, listed), "anchored")
    every = F.array_distinct(F.concat(F.split("_lowered", r"\s+"), F.array(F.lit(""))))
    met = lowered.select(key, "_lowered", F.explode(every).alias("_word")).join(F.broadcast(anchored), "_word")
    return met.filter(F.contains("_lowered", "_low")).select(key, "value").distinct()


def _mentions_by_runs(texts: DataFrame, text: str, key: str, listed: DataFrame) -> DataFrame:
    """The mentions of a list of any length.

    The words of all texts are counted once. Each value is anchored at a run of words around its rarest one, at
    a part of a word, or at itself if it is shorter (``_anchored``). A bitmap of those, of fixed size, goes to the
    texts: what it lets through meets the values anchored there. So texts stay where they are; what is shuffled
    is their words as counts, their distinct words and characters that may hold a short value, and the
    surroundings of runs, as long as the values of their shape. A common anchor's occurrences are dealt
    to ``SALTS`` tasks.
    """
    lowered = texts.select(key, F.lower(text).alias("_text"))
    spoken = lowered.select(F.explode(F.split("_text", r"\s+")).alias("_word")).filter("_word <> ''")
    vocabulary = shared_table(spoken.groupBy("_word").agg(F.count("*").alias("_n")), "vocabulary")
    anchored = shared_table(_anchored(vocabulary, listed), "anchored")
    bits = _bits(anchored)
    # One row a shape, eight at most.
    spans = anchored.groupBy("_shape").agg(F.max("_before").alias("before"), F.max("_after").alias("after")).orderBy("_shape").collect()
    placed = [s for s in spans if s["_shape"] not in ("gram", "word")]
    met = [_spelled_met(lowered, key, s["_shape"], bits) for s in spans if s["_shape"] in ("gram", "word")]
    met += [_runs_met(lowered, key, placed, bits)] if placed else []
    if not met:
        return lowered.select(key, F.lit(None).cast("string").alias("value")).filter(F.lit(False))
    every = reduce(DataFrame.unionByName, met).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    dealt = anchored.drop("_before", "_after").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = F.col("_around").isNull() | F.contains("_around", "_low")
    return every.join(dealt, ["_shape", "_run", "_salt"]).filter(held).select(key, "value").distinct()


def mention_join(texts: DataFrame, text: str, key: str, values: DataFrame, value: str) -> DataFrame:
    """Pairs ``(key, value)`` where a text contains a value, ignoring case. Blank values are left out.

    A list of up to ``LIST_BYTES`` goes to the texts; of its values without a whole word, which are looked for in
    every text, it may hold ``PART_VALUES``. In a longer list values are found by the runs they are anchored at.
    Either way every text and every value is read, and no text is shuffled.
    """
    blank = F.btrim("_low", F.lit(BLANKS)) == ""
    listed = values.select(F.lower(value).alias("_low"), F.col(value).alias("value")).filter(~blank).distinct()
    listed = shared_table(listed, "listed")
    size = listed.agg(
        F.coalesce(F.sum(F.octet_length("_low") + F.octet_length("value")), F.lit(0)).alias("bytes"),
        F.count_if(F.size(_whole_words(F.col("_low"))) == 0).alias("parts"),
    ).first()
    short = size["bytes"] <= LIST_BYTES and size["parts"] <= PART_VALUES
    return (_mentions_in_place if short else _mentions_by_runs)(texts, text, key, listed)


def topic_hints(dimensions: Sequence[str]) -> list[str]:
    """Topics hinted at by the names of the best-scored dimensions."""
    names = [d.lower() for d in dimensions]
    return [t for t, pattern in words.TOPIC_HINTS if any(re.search(pattern, n) for n in names)]


def why_factor_score(
    articles: DataFrame,
    months: DataFrame,
    driver_values: Sequence[str],
    lens: str,
    direction: str,
    hints: Sequence[str] = (),
) -> DataFrame:
    """Score each decorated article as an explanation of a variance.

    ``months`` has the data months as ``month`` (calendar months, so they are broadcast);
    ``driver_values`` are the names and values of the
    leading driver and combinations, a handful.
    """
    weights = words.LENS_WEIGHTS[lens]
    table = {
        **{t: words.HINTED_WEIGHT for t in hints},
        **weights,
    }
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    topics = F.when(F.size("tags") > 0, F.array_distinct("tags")).otherwise(F.array(F.lit("market context")))
    text = F.lower(F.concat_ws(" ", "title", "snippet", F.array_join("tags", " ")))
    mentions = sum((F.col("_text").contains(v.lower()).cast("int") for v in driver_values if v), F.lit(0))
    month = month_key(F.col("published_at"))
    dated = articles.withColumn("month", month).join(
        F.broadcast(months.select("month").distinct().withColumn("_seen", F.lit(True))), "month", "left"
    )
    sentiment = F.col("sentiment")
    tone = {
        "unfavorable": F.when(sentiment == "negative", 16).when(sentiment == "positive", 6).otherwise(9),
        "favorable": F.when(sentiment == "positive", 14).when(sentiment == "negative", 5).otherwise(8),
    }.get(direction, F.lit(6))
    weight = F.aggregate(
        "topics",
        F.lit(0.0),
        lambda s, t: s + F.coalesce(F.try_element_at(known, t), F.lit(words.OTHER_WEIGHT)),
    )
    scored = dated.withColumns({"topics": topics, "_text": text}).withColumns(
        {
            "topic_score": F.least(F.lit(28.0), weight * 10),
            "driver_score": F.least(F.lit(22), mentions * 8),
            "time_score": F.when(F.col("_seen"), 16).when(F.col("month").isNotNull(), 8).otherwise(4),
            "direction_score": tone,
            "angle_score": F.when(F.col("angle") == "active", 12).otherwise(10),
            "competition_boost": F.when(
                (F.col("angle") == "passive") & F.array_contains("topics", "competition/pricing"), 9
            ).otherwise(0),
        }
    )
    parts = ["topic_score", "driver_score", "time_score", "direction_score", "angle_score", "competition_boost"]
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    score = F.least(F.lit(100), F.floor(total + 0.5)).cast("int")
    return scored.withColumn("score", score).withColumn(
        "confidence", F.when(F.col("score") >= 72, "high").when(F.col("score") >= 48, "medium").otherwise("low")
    ).drop("_seen", "_text")


def top_why_factors(scored: DataFrame, k: int = TOP_FACTORS) -> DataFrame:
    return scored.orderBy(F.desc("score"), "row_idx").limit(k)
