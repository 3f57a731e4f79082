"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression of the text, every rule compares one ratio with a bound, and all
rules become columns of a single ``select``: no user functions, no shuffle, no second scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variscope.llm.words import SPACE_CLASS, SPACES, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on with as was are be by this from or an "
    "der die das und zu von ist mit den im ein eine nicht für auf sich es dem "
    "le la les de des et en un une du est que qui dans pour pas sur au "
    "el los las y por con para del se una no"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio of the text must lie within [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word, or per line with a word.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.5, 12.0),
    Rule("few_symbols", "symbols_per_word", None, 0.1),
    Rule("has_stop_words", "stop_words_per_word", 0.04, None),
    Rule("few_repeated_lines", "dup_line_ratio", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def place_bits(words: Column) -> Column:
    """Bits that hold any place in the array."""
    return F.ceil(F.log2(F.greatest(F.size(words), F.lit(2)))).cast("int")


def right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def repeated_word_count(words: Column, bits: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more.

    Windows are first told apart by a hash packed with their place into one long, so that sorting works on
    plain longs. The places whose hash recurs are then compared by their words, so the count is exact.
    """
    n = F.size(words)

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def packed(h: Column, i: Column) -> Column:
        return left(right(h, bits), bits).bitwiseOR(i.cast("long"))

    def recurring(rows: Column, same) -> Column:
        """The entries of a sorted array that equal the one before or after; mostly none, so one look comes first."""
        first = F.filter(rows, lambda x, i: same(x, F.get(rows, i + 1)))
        both = F.filter(rows, lambda x, i: F.coalesce(same(x, F.get(rows, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False)))
        return F.when(F.size(first) == 0, first).otherwise(both)

    places = F.when(n >= 3, F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    # A lambda over a one-element array names the value, so that it is computed once.
    def bind(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def exact(candidates: Column) -> Column:
        grams = F.transform(
            candidates,
            lambda k: bind(
                k.bitwiseAND(left(F.lit(1).cast("long"), bits) - 1).cast("int"),
                lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")),
            ),
        )
        twice = bind(F.sort_array(grams), lambda s: recurring(s, lambda x, y: x["g"] == y["g"]))
        covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    def candidates(hashes: Column) -> Column:
        return bind(F.sort_array(F.transform(hashes, packed)), lambda s: recurring(s, lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0))

    def counted(hashes: Column) -> Column:
        return bind(candidates(hashes), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(exact(c)))

    # Most texts repeat no window: as many different hashes as windows says so without sorting.
    alone = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return bind(F.transform(places, window_hash), lambda h: F.when(alone(h), F.lit(0)).otherwise(counted(h))).cast("long")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that rules may name. A null text counts as empty; nothing else is read."""
    t = F.coalesce(F.col(text), F.lit(""))
    clash = [c for c in docs.columns if c.startswith("_q_")]
    if clash:
        raise ValueError(f"columns starting with _q_ are reserved: {clash}")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # Words, then the numbers that need them; each array is made once for each row.
    one = docs.withColumn("_q_words", words_of(F.col(text))).withColumn("_q_lines", lines).withColumn("_q_bits", place_bits(F.col("_q_words")))
    # A generator of one row keeps filters on the verdict from repeating this work below it.
    counts = F.struct(
        F.size("_q_words").cast("long").alias("_q_n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("_q_word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long").alias("_q_n_symbols"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        repeated_word_count(F.col("_q_words"), F.col("_q_bits")).alias("_q_n_repeat_words"),
        F.size(F.filter("_q_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("_q_n_stop_words"),
    )
    return one.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(counts)))


def measures() -> dict[str, Column]:
    """The ratios by the names that a threshold table uses; a text without words or lines has ratio 0."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": per("_q_word_chars", "_q_n_words"),
        "symbols_per_word": per("_q_n_symbols", "_q_n_words"),
        "stop_words_per_word": per("_q_n_stop_words", "_q_n_words"),
        "dup_line_ratio": per("_q_n_dup_lines", "_q_n_lines"),
        "repeat_word_ratio": per("_q_n_repeat_words", "_q_n_words"),
    }


def compiled(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean column for each rule: whether the row passes."""
    known = measures()
    out: dict[str, Column] = {}
    for r in rules:
        if r.measure not in known:
            raise ValueError(f"unknown measure {r.measure!r}; known: {sorted(known)}")
        value, ok = known[r.measure], F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
        out[r.name] = ok
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Add the counts, ``base_failed``, ``failed_rules`` (array) and ``kept`` to every row.

    Rows are judged on their own: repeated rows get the same verdict, null and empty texts fail the base
    rule, columns of the input stay. Names already taken by the input raise an error.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    taken = {*added, "base_failed", "failed_rules", "kept"} & set(docs.columns)
    if taken:
        raise ValueError(f"the input has columns that the verdict adds: {sorted(taken)}")
    base = (F.col("_q_n_words") < min_words) | (F.col("_q_n_repeat_words") * 100 > F.col("_q_n_words") * max_repeat_percent)
    passed = compiled(rules)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]), lambda x: x.isNotNull()) if passed else F.array().cast("array<string>")
    verdict = ~base
    for ok in passed.values():
        verdict = verdict & ok
    return with_measures(docs, text).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[F.col(f"_q_{c}").alias(c) for c in added],
        base.alias("base_failed"),
        failed.alias("failed_rules"),
        verdict.alias("kept"),
    )
