"""Phrases whose words go together, mined with stripes.

A stripe is a prefix with an associative counter of the words that follow it. Tasks build the stripes of their
texts, and equal prefixes' stripes are merged elementwise. Stripes travel in blocks by the hash of their prefix; a
stripe is split over ``STRIPE_PARTS`` blocks by its next words, and that of the empty prefix, which is the
vocabulary, over all, so that no common prefix is one task's work. From merged stripes come the frequencies of all
phrases (an entry), of their beginnings (an entry of the shorter prefix), and the greatest frequency of a phrase
that goes on by a word to either side (maxima over entries).

Prefixes grow a word at a time. A phrase can be frequent only if what it is without its first and without its
last word is; phrases of such places are first counted by hash, in buckets, and only those of full buckets become
stripes. Both filters are bitmaps of fixed size, which let some others through but stop no frequent one, at any
size of the corpus; exact counts decide.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variscope.llm.scratch import stored

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Bytes of texts whose stripes a task builds at once.
CHUNK_BYTES = 8 << 20
#: Blocks that share the stripe of one prefix.
STRIPE_PARTS = 4
#: Bits of the maps of phrases, and buckets of hashed phrases: 16 MB, in rows of the 32,768 bits that Spark's bitmap functions build.
BITMAP_BITS = 1 << 27
BITMAP_ROW = 1 << 15
# A phrase's hash is a polynomial in the CRC-32 of its words; the modulus keeps a step within 63 bits.
HASH_BASE = 1_000_003
HASH_PRIME = (1 << 31) - 1
# Letters A-Z become lower case, a tab a space, and what parts pieces a full stop.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in ENDS else b for b in range(256))


def coded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Texts in UTF-8 as codes of their words, 0 where a piece or a text ends, and the words by code."""
    whole = b".".join(texts).translate(_TOKENS).replace(b".", b" . ")
    found = pc.split_pattern(pa.array([b" . " + whole + b" . "], pa.large_binary()), b" ").values.dictionary_encode()
    codes, words = found.indices.to_numpy(), found.dictionary
    # The first token is an empty string and the second a full stop.
    return codes[codes > 0].astype(np.int64) - 1, words.slice(1)


class FrequentPhrases:
    """A bitmap that holds all frequent phrases of one length, and perhaps others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return (self.bits[hashes >> 3] >> (hashes & 7).astype(np.uint8)) & 1 == 1


def gathered(rows: DataFrame) -> FrequentPhrases:
    """The bitmap of rows (row, bits): what is collected is at most its own size."""
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows.collect():
        begin = r["row"] * (BITMAP_ROW // 8)
        out[begin : begin + BITMAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return FrequentPhrases(out)


def bitmap(phrases: DataFrame) -> FrequentPhrases:
    """The bitmap of phrases (lang, words)."""
    start = F.crc32(F.encode("lang", "UTF-8")) % HASH_PRIME
    hashed = F.aggregate("words", start, lambda h, w: (h * HASH_BASE + F.crc32(F.encode(w, "UTF-8"))) % HASH_PRIME) % BITMAP_BITS
    at = phrases.select(hashed.alias("h")).select(F.floor(F.col("h") / BITMAP_ROW).alias("row"), (F.col("h") % BITMAP_ROW).alias("bit"))
    return gathered(at.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")))


def windows_of(text: np.ndarray, length: int) -> np.ndarray:
    """Places at which so many tokens that are words begin (0 is no word)."""
    many = max(len(text) - length + 1, 0)
    ok = text[:many] > 0
    for i in range(1, length):
        ok = ok & (text[i : i + many] > 0)
    return np.flatnonzero(ok)


def hashes(text: np.ndarray, crc: np.ndarray, lang: bytes, length: int) -> np.ndarray:
    """Buckets of the phrases of so many words that begin at each place; they mean nothing where a piece ends inside."""
    many = max(len(text) - length + 1, 0)
    h = np.full(many, crc32(lang) % HASH_PRIME, np.int64)
    for i in range(length):
        h = (h * HASH_BASE + crc[text[i : i + many]]) % HASH_PRIME
    return h % BITMAP_BITS


def chunks(batches):
    """Texts of rows (lang, text) by their lang, about ``CHUNK_BYTES`` at a time."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= CHUNK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def full_buckets(texts: DataFrame, length: int, frequent: FrequentPhrases, min_count: int) -> FrequentPhrases:
    """Buckets with ``min_count`` phrases of ``length`` words or more, of places whose shorter phrases ``frequent`` may hold.

    Tasks send the filled places of each row of the bitmap with their counts, up to ``min_count``.
    """
    kind = np.uint8 if min_count < 256 else np.uint32

    def count(batches):
        for lang, some in chunks(batches):
            text, words = coded(some)
            crc = np.fromiter(map(crc32, words.to_pylist()), np.int64, len(words))
            at = windows_of(text, length)
            known = frequent.holds(hashes(text, crc, lang, length - 1))
            at = at[known[at] & known[at + 1]]
            bucket, n = np.unique(hashes(text, crc, lang, length)[at], return_counts=True)
            if not len(bucket):
                continue
            begin = np.flatnonzero(np.append(True, np.diff(bucket // BITMAP_ROW) > 0))
            cut = lambda x: [y.tobytes() for y in np.split(x, begin[1:])]  # noqa: B023, E731
            columns = [pa.array(bucket[begin] // BITMAP_ROW), pa.array(cut((bucket % BITMAP_ROW).astype(np.uint16)), pa.binary()), pa.array(cut(np.minimum(n, min_count).astype(kind)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "places", "n"])

    def merge(batches):
        row, total = None, np.zeros(BITMAP_ROW, np.int64)

        def done():
            bits = np.packbits(total >= min_count, bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([bits.tobytes()], pa.binary())], ["row", "bits"])

        for batch in batches:
            for r, places, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != row:
                    if row is not None:
                        yield done()
                    row = r
                    total[:] = 0
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(n, kind)
        if row is not None:
            yield done()

    counted = texts.mapInArrow(count, "row long, places binary, n binary")
    return gathered(counted.repartition("row").sortWithinPartitions("row").mapInArrow(merge, "row long, bits binary"))


def partial_stripes(texts: list[bytes], lang: bytes, length: int, wanted: FrequentPhrases | None, blocks: int):
    """Stripes of the prefixes of ``length`` words in some texts: a row for each block, with prefixes (by line), how
    many words follow each, the next words (by spaces) and their counts."""
    text, words = coded(texts)
    crc = np.fromiter(map(crc32, words.to_pylist()), np.int64, len(words))
    if length:
        at = windows_of(text, length + 1)
        at = at[wanted.holds(hashes(text, crc, lang, length + 1))[at]]
        prefix = text[at]
        for i in range(1, length):  # numbers of equal prefixes, a word at a time
            _, prefix = np.unique(prefix * len(words) + text[at + i], return_inverse=True)
        following = text[at + length]
        block = (hashes(text, crc, lang, length)[at] + crc[following] % STRIPE_PARTS) % blocks
        order = np.lexsort((following, prefix, block))
        block, prefix, following, at = block[order], prefix[order], following[order], at[order]
        entry = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (following[1:] != following[:-1])))[: len(order)]
        n = np.diff(np.append(entry, len(order)))
        block, prefix, following, at = block[entry], prefix[entry], following[entry], at[entry]
    else:
        following = np.arange(1, len(words))
        following = following[np.argsort(crc[1:] % blocks)]
        block, n = crc[following] % blocks, np.bincount(text, minlength=len(words))[following]
        prefix = at = np.zeros(len(following), np.int64)
    if not len(following):
        return
    stripe = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (block[1:] != block[:-1])))
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    spell = lambda c: words.take(pa.array(c))
    spelled = pc.binary_join_element_wise(*[spell(text[at[stripe] + i]) for i in range(length)], pa.scalar(b" ", words.type)) if length else pa.array([b""] * len(stripe), words.type)
    lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(np.append(bounds, len(values)).astype(np.int32)), values)
    plain = lambda x: x.cast(pa.binary()).cast(pa.string())
    by_stripe = np.searchsorted(stripe, begin)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([lang.decode()] * len(begin), pa.string()),
            pa.array(block[begin].astype(np.int32)),
            pc.binary_join(lists(by_stripe, plain(spelled)), "\n"),
            lists(by_stripe, pa.array(np.diff(np.append(stripe, len(following))).astype(np.int32))),
            pc.binary_join(lists(begin, plain(spell(following))), " "),
            lists(begin, pa.array(n.astype(np.int32))),
        ],
        ["lang", "block", "prefixes", "sizes", "next", "n"],
    )


def stripes(texts: DataFrame, length: int, wanted: FrequentPhrases | None, blocks: int) -> DataFrame:
    """Tasks' blocks of stripes of the prefixes of ``length`` words, of texts (lang, text in UTF-8), with the entries that ``wanted`` may hold."""

    def build(batches):
        for lang, some in chunks(batches):
            yield from partial_stripes(some, lang, length, wanted, blocks)

    return texts.mapInArrow(build, "lang string, block int, prefixes string, sizes array<int>, next string, n array<int>")


def merged(partial: DataFrame, min_count: int) -> DataFrame:
    """Stripes merged elementwise, block by block: an entry (lang, phrase, f) for each frequent phrase, and for each block one without a phrase that has the sum of all its entries."""

    def merge(batches):
        at, held = None, []

        def done():
            spread = lambda text, by: pa.array(text.split(by), pa.large_string())
            parts = []
            for prefixes, sizes, following, _ in held:
                prefix = spread(prefixes, "\n").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                parts.append(pc.binary_join_element_wise(prefix, spread(following, " "), pa.scalar(" ", pa.large_string())))
            found = pa.chunked_array(parts).combine_chunks().dictionary_encode()
            total = np.bincount(found.indices.to_numpy(), weights=np.concatenate([h[3] for h in held])).astype(np.int64)
            some = np.flatnonzero(total >= min_count)
            phrases = pa.concat_arrays([found.dictionary.take(pa.array(some)).cast(pa.string()), pa.array([None], pa.string())])
            counts = pa.array(np.append(total[some], total.sum()))
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(counts), pa.string()), phrases, counts], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, block, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, block) != at:
                    if held:
                        yield done()
                    at, held = (lang, block), []
                held.append(rest)
        if held:
            yield done()

    return partial.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(merge, "lang string, phrase string, f long")


def frequencies(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The frequent phrases (lang, words, f) of up to ``longest`` words and, for each lang, the number of its words (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.encode(F.coalesce(F.col(lang), F.lit("und")), "UTF-8").alias("lang"), F.encode(F.col(text), "UTF-8").alias("text"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, totals = [], None
    for length in range(longest):
        wanted = full_buckets(texts, length + 1, bitmap(levels[-1]), min_count) if length else None
        entries = stored(merged(stripes(texts, length, wanted, blocks), min_count), "frequent")
        if not length:
            totals = entries.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
        words = F.split(F.ltrim("phrase"), " ", -1)
        levels.append(entries.filter("phrase IS NOT NULL").select("lang", words.alias("words"), "f"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def cut_scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Every cut of the phrases of two words or more: lang, words, a, k, l, r, n and score, the floor of 1000 a n / (l r), exactly."""
    known = phrases.select("lang", F.array_join("words", " ").alias("part"), "f")
    cuts = phrases.filter(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    score = F.expr("(`_a` * `_n` * 1000BD) div (`_l` * `_r`)")
    return cuts.withColumns({f"_{c}": v for c, v in wide.items()}).select("lang", "words", "a", "k", "l", "r", "n", score.alias("score"))


def longer_maxima(phrases: DataFrame) -> DataFrame:
    """For each phrase that goes on by a word to either side in another one: lang, words and the greatest frequency of those."""
    both = phrases.filter(F.size("words") > 2).select("lang", "f", F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"))
    return both.groupBy("lang", "words").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """Phrases of two to ``longest`` words with at least ``min_count`` occurrences: lang, phrase, words, a, l, r, n and score, that of the lowest-scoring cut.

    A phrase goes if a longer candidate that holds it is as frequent; one that is longer by a word tells, as no
    longer one is more frequent than those between. A null lang is ``und``; null and empty texts have no words;
    repeated rows count each time; other columns are not read.
    """
    phrases, totals = frequencies(docs, longest, min_count, text, lang)
    scored = cut_scores(phrases, totals).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = scored.join(longer_maxima(phrases), ["lang", "words"], "left").filter("longer IS NULL OR longer < a")
    return kept.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "cut.l", "cut.r", "n", "cut.score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each lang by score, then frequency, then phrase, with their ``rank``."""
    rank: Column = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
