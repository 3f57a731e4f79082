"""Benchmark decontamination with one FM-index for each shard of the training texts.

A shard is a run of documents of about ``SHARD_WORDS`` words. Its words become codes of the shard's own vocabulary,
each document ends with a separator, and the Burrows-Wheeler transform of the codes is kept as a wavelet tree,
stored level by level, with the places of every ``SAMPLE``-th suffix. The index depends on no benchmark: it is a
table in the shared folder that any number of phrase sets can be searched in. Phrases are searched backwards, all
of a block at once; a step narrows every phrase's range of suffixes by two ranks in the wavelet tree. Ranges that
are left are walked to the nearest sampled suffixes, which gives the places, and places become spans to remove.

Phrases go through the driver a block of ``BLOCK_WORDS`` words at a time, as a broadcast would; a benchmark of any
size is so many blocks, each searched in the stored index. Shards are cut from one partition's rows in their
order, so a lost task builds the same shards again. A longer document than a shard goes on in the next one, which
repeats as many words as a phrase may have before the cut, so no occurrence is lost.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.llm.scratch import stored
from variscope.llm.urls import LOWER, UPPER
from variscope.llm.words import alnum_words

WIDTH = 10
SHARD_WORDS = 1 << 19
SAMPLE = 8
#: Words of the phrases that are searched at once.
BLOCK_WORDS = 1 << 20
#: Occurrences that are located at once.
LOCATED = 1 << 20
#: Documents of a shard, which may have no words.
SHARD_DOCS = 1 << 16
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``text`` in order. 0 is a separator and must stand last; separators come before all words, earlier ones first.

    The first order is by a few words at once; then the suffixes that are still tied are ordered by the rank of
    what follows, which doubles the words compared in each round.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    first = text.astype(np.int64) + (len(ends) - 1)
    first[ends] = np.arange(len(ends))
    bits = max(1, int(first.max()).bit_length())
    h = 63 // bits
    key = first.copy()
    for j in range(1, min(h, n)):
        key <<= bits
        key[: n - j] |= first[j:]
    places = np.argsort(key)
    key = key[places]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[places] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.arange(n)
    while True:
        alone = fresh[tied] & np.append(fresh[1:], True)[tied]
        tied = tied[~alone]
        if not len(tied):
            return places
        at = places[tied]
        key = (rank[at] << 32) | rank[at + h]  # a tied suffix has h words before its separator
        order = np.argsort(key)
        key, at = key[order], at[order]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        places[tied], fresh[tied] = at, new
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        h *= 2


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with at least one bit to spare."""
    out = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
    some = np.packbits(bits, bitorder="little")
    out[: len(some)] = some
    return out.view("<u8")


class Bits:
    """A bit vector with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


def index_arrays(text: np.ndarray, starts: np.ndarray, levels: int) -> tuple[bytes, bytes, bytes]:
    """Wavelet levels, marks of the sampled suffixes and their places, of a text of codes; ``starts`` are sampled as well."""
    places = suffix_array(text)
    symbols = text[places - 1]  # place -1 is the last separator
    tree = []
    for shift in range(levels - 1, -1, -1):
        one = ((symbols >> shift) & 1).astype(bool)
        tree.append(packed(one))
        symbols = np.concatenate([symbols[~one], symbols[one]])
    marked = places % SAMPLE == 0
    begins = np.zeros(len(text), bool)
    begins[starts] = True
    marked |= begins[places]
    return np.concatenate(tree).tobytes() if tree else b"", packed(marked).tobytes(), places[marked].astype("<u4").tobytes()


class Index:
    """The FM-index of a shard, ready for searches."""

    def __init__(self, size: int, vocabulary: bytes, counts: bytes, tree: bytes, marks: bytes, samples: bytes):
        self.codes = {w: n + 1 for n, w in enumerate(vocabulary.split(b" "))} if vocabulary else {}
        self.before = np.zeros(len(self.codes) + 2, np.int64)  # suffixes that begin with a lesser code
        np.cumsum(np.frombuffer(counts, "<u4"), out=self.before[1:])
        words = size // 64 + 1
        bits = np.frombuffer(tree, "<u8")
        self.levels = [Bits(bits[i : i + words]) for i in range(0, len(bits), words)]
        self.zeros = [size - int(x.rank(np.array([size]))[0]) for x in self.levels]
        self.marks = Bits(np.frombuffer(marks, "<u8"))
        self.samples = np.frombuffer(samples, "<u4")

    def sink(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the rows before ``at`` that hold ``code`` end in the lowest level."""
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where((code >> (len(self.levels) - 1 - depth)) & 1, zeros + ones, at - ones)
        return at

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur and their ranges of suffixes. A row of codes is a phrase, filled with 0 on its left; -1 is an unknown word."""
        some = np.flatnonzero((phrases >= 0).all(axis=1) & (phrases[:, -1] > 0))
        low, high = np.zeros(len(some), np.int64), np.full(len(some), self.before[-1])
        code, place = np.unique(phrases[some], return_inverse=True)
        base = self.before[code] - self.sink(code, np.zeros(len(code), np.int64))
        place = place.reshape(len(some), phrases.shape[1])
        for column in range(phrases.shape[1] - 1, -1, -1):
            more = np.flatnonzero((code[place[:, column]] > 0) & (low < high))
            p = place[more, column]
            both = self.sink(np.tile(code[p], 2), np.concatenate([low[more], high[more]])) + np.tile(base[p], 2)
            low[more], high[more] = both[: len(more)], both[len(more) :]
        hit = low < high
        return some[hit], low[hit], high[hit]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order: back by one word until a sampled suffix is met."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            here = self.marks.get(rows) == 1
            out[left[here]] = self.samples[self.marks.rank(rows[here])] + steps
            left, rows = left[~here], rows[~here]
            at, first, code = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for level, zeros in zip(self.levels, self.zeros, strict=True):
                bit = level.get(at)
                a, b = level.rank(at), level.rank(first)
                at, first, code = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, first - b), 2 * code + bit
            rows, steps = self.before[code] + at - first, steps + 1
        return out


def build_index(docs: DataFrame, longest: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a shard, stored in the shared folder: its FM-index and the documents in it.

    ``longest`` is the most words of a phrase to be searched. Every row of ``docs`` is a document with a number
    ``row`` of its own, whatever its key; null and empty texts have no words.
    """
    kind = docs.schema[key].dataType
    docs_type = T.ArrayType(
        T.StructType([T.StructField("row", T.LongType()), T.StructField("key", kind), T.StructField("start", T.IntegerType()), T.StructField("from_word", T.LongType()), T.StructField("words", T.LongType())])
    )
    binary = ["vocabulary", "counts", "tree", "marks", "samples"]
    schema = T.StructType([T.StructField("size", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in binary], T.StructField("docs", docs_type)])

    def build(batches):
        def fresh():
            return defaultdict(count(1).__next__), [], [], 0

        def shard(codes, text, held, key_type):
            levels = max(len(codes), 1).bit_length()
            whole = np.concatenate(text) if text else np.zeros(1, np.int32)
            starts = np.array([d["start"] for d in held if d["words"]] or [0])
            parts = [b" ".join(codes), np.bincount(whole, minlength=len(codes) + 1).astype("<u4").tobytes(), *index_arrays(whole, starts, levels)]
            struct = pa.struct([("row", pa.int64()), ("key", key_type), ("start", pa.int32()), ("from_word", pa.int64()), ("words", pa.int64())])
            arrays = [pa.array([len(whole)], pa.int32()), *[pa.array([p], pa.binary()) for p in parts], pa.array([held], pa.list_(struct))]
            return pa.RecordBatch.from_arrays(arrays, ["size", *binary, "docs"])

        codes, text, held, size = fresh()
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(1).type
            for row, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = alnum_words(t)
                done = 0
                while True:
                    room = max(SHARD_WORDS - size, 2 * longest)
                    some = words[done : done + room]
                    held.append({"row": row, "key": k, "start": size, "from_word": done, "words": len(some)})
                    if some:
                        text += [np.fromiter(map(codes.__getitem__, some), np.int32, len(some)), np.zeros(1, np.int32)]
                        size += len(some) + 1
                    if size >= SHARD_WORDS or len(held) >= SHARD_DOCS:
                        yield shard(codes, text, held, key_type)
                        codes, text, held, size = fresh()
                    if done + len(some) >= len(words):
                        break
                    done += len(some) - (longest - 1)
        if held:
            yield shard(codes, text, held, key_type)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.encode(F.col(text), "UTF-8").alias("text"))
    return stored(rows.mapInArrow(build, schema), "fm-index")


def phrases_of(items: DataFrame, width: int = WIDTH, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the items (number, words) and which items hold them (number, item as a string).

    A window is ``width`` consecutive words; an item of fewer words is one window, one without words has none.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(1))
    several = F.transform(F.sequence(F.lit(1), F.size("_w") - width + 1), lambda i: F.slice("_w", i, width))
    cut = F.when(F.size("_w") >= width, several).when(F.size("_w") > 0, F.array("_w"))
    windows = items.select(F.col(key).cast("string").alias("item"), words.alias("_w")).select("item", F.explode(cut).alias("words")).distinct()
    windows = stored(windows, "windows")
    phrases = stored(windows.select("words").distinct().select(F.monotonically_increasing_id().alias("number"), "words"), "phrases")
    return phrases, stored(windows.join(phrases, "words").select("number", "item"), "phrase-items")


def search(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Hits (row, spans, numbers) of the phrases (number, words): for each document of a shard the merged spans of its words, from and to (exclusive), and which phrases they come from."""
    spark = index.sparkSession
    sizes = phrases.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    blocks = -(-(sizes["words"] or 0) // BLOCK_WORDS)
    schema = "row long, spans array<struct<from: long, to: long>>, numbers array<long>"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()  # about BLOCK_WORDS words
        found = found.union(index.mapInArrow(searcher([r["number"] for r in part], [r["words"] for r in part]), schema))
    return found


def searcher(numbers: list[int], phrases: list[list[str]]):
    """The task function that searches a block of phrases in index rows."""
    vocabulary = {w: n for n, w in enumerate(sorted({w for p in phrases for w in p}))}
    width = max(map(len, phrases), default=1)
    matrix = np.full((len(phrases), width), -1, np.int32)
    for n, p in enumerate(phrases):
        matrix[n, width - len(p) :] = [vocabulary[w] for w in p]
    words = [w.encode() for w in vocabulary]
    lengths, numbers = np.array([len(p) for p in phrases], np.int64), np.array(numbers, np.int64)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("size", "vocabulary", "counts", "tree", "marks", "samples")}
                index = Index(**row)
                codes = np.array([index.codes.get(w, -1) for w in words] + [0])  # the last one: no word
                which, low, high = index.find(codes[matrix])
                if not len(which):
                    continue
                docs = batch.column("docs")[n].values.filter(pa.compute.greater(pa.compute.struct_field(batch.column("docs")[n].values, "words"), 0))
                starts, from_word, rows = (docs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "from_word", "row"))
                out = []
                for which_, places in located(index, which, low, high):
                    doc = np.searchsorted(starts, places, "right") - 1
                    out.append((doc, places - starts[doc] + from_word[doc], which_))
                yield from hits(*map(np.concatenate, zip(*out, strict=True)), rows, lengths, numbers)

    return run


def located(index: Index, which, low, high):
    """The occurrences of phrases, some ``LOCATED`` at a time: phrases and places."""
    ends = np.cumsum(high - low)
    for begin in range(0, int(ends[-1]), LOCATED):
        at = np.arange(begin, min(begin + LOCATED, int(ends[-1])))
        phrase = np.searchsorted(ends, at, "right")
        yield which[phrase], index.locate(high[phrase] - (ends[phrase] - at))


def hits(doc, place, which, rows, lengths, numbers):
    """Record batches of the spans, merged in each document, and the phrases in it."""
    order = np.lexsort((place, doc))
    d, a, b = doc[order], place[order], (place + lengths[which])[order]
    step = int(b.max()) + 1
    reach = np.maximum.accumulate(d * step + b)  # the furthest end so far; documents do not meet
    first = np.ones(len(d), bool)
    first[1:] = d[1:] * step + a[1:] > reach[:-1]
    first[1:] |= d[1:] != d[:-1]
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(d)) - 1
    spans = pa.StructArray.from_arrays([pa.array(a[begin]), pa.array(reach[last] - d[begin] * step)], ["from", "to"])
    pair = np.unique(np.stack([doc, which], axis=1), axis=0)
    docs = np.unique(doc)
    bounds = [pa.array(np.append(np.searchsorted(x, docs), len(x)).astype(np.int32)) for x in (d[begin], pair[:, 0])]
    lists = [pa.ListArray.from_arrays(bounds[0], spans), pa.ListArray.from_arrays(bounds[1], pa.array(numbers[pair[:, 1]]))]
    yield pa.RecordBatch.from_arrays([pa.array(rows[docs]), *lists], ["row", "spans", "numbers"])


def merged_spans(found: DataFrame) -> DataFrame:
    """``row`` and its ``spans`` in order, where spans of several shards or blocks that touch become one."""
    flat = found.select("row", F.explode("spans").alias("s")).select("row", F.col("s.from").alias("a"), F.col("s.to").alias("b"))
    by_row = Window.partitionBy("row").orderBy("a", "b")
    reach = F.max("b").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = flat.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "run").agg(F.min("a").alias("from"), F.max("b").alias("to"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """For each row of ``docs``: its key, n_words, n_hit, the merged ``spans`` of hit words (from, to exclusive) and ``items``, the ids of the items found in it, sorted as strings.

    Null and empty texts have no words and no hits; repeated rows have a row each; rows of ``items`` that share an
    id are one item, and an item without id marks words but is not listed. Other columns are left out.
    """
    index = build_index(docs, width, key, text)
    phrases, holders = phrases_of(items, width, item_key)
    found = stored(search(index, phrases), "hits")
    pieces = index.select(F.explode("docs").alias("d")).select("d.*")
    rows = pieces.groupBy("row").agg(F.first("key").alias(key), F.max(F.col("from_word") + F.col("words")).alias("n_words"))
    named = found.select("row", F.explode("numbers").alias("number")).join(holders, "number").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(merged_spans(found), "row", "left").join(named, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select(
        key,
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<from: long, to: long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text with the words of the spans, and what stands between them, cut out; null stays null."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    first = F.when(F.element_at(tokens, 1).rlike(r"^[A-Za-z0-9\x{80}-\x{10FFFF}]"), 0).otherwise(1)  # words and what parts them take turns
    inside = F.filter(tokens, lambda t, i: ~F.exists(spans, lambda s: (i >= 2 * s["from"] + first) & (i <= 2 * s["to"] - 2 + first)))
    return F.when(F.size(tokens) <= 0, text).otherwise(F.array_join(inside, ""))
