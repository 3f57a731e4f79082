"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents above a third of the capacity meet at most twice in a sequence: they are paired greedily, the longest
with the longest partner that fits. Smaller documents then go, longest first, into the smallest gap that
holds them. All documents of one length are alike, so the decisions are taken on the histogram of lengths,
which has at most ``capacity`` entries whatever the corpus; the corpus only ranks its rows inside each
length and reads off their places.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
#: Rows of one length are ranked in so many parts, so that a length that most rows share is no single task.
RANK_PARTS = 64
FLUSH_BYTES = 8 << 20
#: Blanks in a row that the fast library's pattern, which looks ahead, is trusted with; it fails at about a million.
LONG_BLANKS = 20_000
# Fixed value: the pattern that cuts a text for this kind of vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_spellings() -> dict[str, int]:
    """The character by which byte-level vocabularies spell each byte: itself if it is printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def encoder(path: str, end_id: int):
    """A function from text to the bytes of its ids (unsigned 32 bit, little-endian) and the end id.

    The ids are those of the tokenizer in the file. Rare words cost its merge loop most of the time, so for a
    plain byte-level BPE file the merges run on ranks read from it, in another library that is several times as
    fast; texts that hold a special token of the file or a very long run of blanks, and all texts of other kinds
    of file, take the tokenizer.
    """
    import json
    import re

    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    end = np.array([end_id], "<u4").tobytes()
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def plain(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end

    settings = json.loads(tok.to_str())
    steps = settings.get("pre_tokenizer") or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if settings.get("normalizer") or settings["model"].get("type") != "BPE" or any(steps.get(k) != v for k, v in usual.items()):
        return plain
    spelled = byte_spellings()
    ranks = {bytes(spelled[c] for c in piece): n for piece, n in tok.get_vocab(with_added_tokens=False).items() if piece not in special}
    fast = tiktoken.Encoding("by_ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    blanks = re.compile(rf"\s{{{LONG_BLANKS}}}")

    def encode(text: str) -> bytes:
        if any(s in text for s in special) or len(text) >= LONG_BLANKS and blanks.search(text):
            return plain(text)
        return np.array(fast.encode_ordinary(text), "<u4").tobytes() + end

    return encode


def worker_encoder(path: str, end_id: int):
    """The encoder of this worker process: it serves later tasks too."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if (path, end_id) not in kept:
        kept[path, end_id] = encoder(path, end_id)
    return kept[path, end_id]


def cut(ids: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; only its first piece may be shorter than the capacity."""
    start, size = 0, ids % capacity or min(ids, capacity)
    while start < ids:
        yield start, size
        start, size = start + size, capacity


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids (binary, unsigned 32 bit, little-endian).

    ``path`` names the vocabulary file, on every executor. A null or empty text has the end id alone;
    repeated rows have a piece each; other columns are left out.
    """
    import pyarrow as pa

    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches):
        encode = worker_encoder(path, end_id)

        def table(keys, rows):
            piece, start, length, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                [key, "piece", "start", "length", "ids"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, rows, held = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(t or "")
                held += len(ids)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    keys.append(k)
                    rows.append((piece, start, length, ids[4 * start : 4 * (start + length)]))
                if held >= FLUSH_BYTES:
                    yield table(keys, rows)
                    keys, rows, held = [], [], 0
            if rows:
                yield table(keys, rows)

    return docs.select(key, text).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for a histogram of lengths: rows (length, rank from, rank to, first sequence, offset), and the sequences used.

    The rows of one length with ranks from ``rank from`` go one by one into sequences from ``first sequence``
    on, each at ``offset``. Large lengths are paired first, small ones take the smallest gap that fits.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = {n: c for n, c in counts.items() if c > 0}
    placed = dict.fromkeys(left, 0)
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by free room: runs of [first sequence, how many]
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(n: int, first: int, many: int, offset: int) -> None:
        rows.append((n, placed[n], placed[n] + many, first, offset))
        placed[n] += many
        left[n] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            fits = (m for m in large if m <= min(n, capacity - n) and left[m] > (m == n))
            partner = next(fits, None)
            many = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, used, many, 0)
            if partner is not None:
                put(partner, used, many, n)
            gaps[capacity - n - (partner or 0)].append([used, many])
            used += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        room = n
        while left[n]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:  # no gap holds it: open sequences for all that remain
                many = -(-left[n] // (capacity // n))
                put(n, used, many, 0)
                gaps[capacity - n].append([used, many])
                used += many
                room = n
                continue
            run = gaps[room][-1]
            many = min(run[1], left[n])
            run[1] -= many
            first = run[0] + run[1]
            if not run[1]:
                gaps[room].pop()
            put(n, first, many, capacity - room)
            gaps[room - n].append([first, many])
            room = min(room, room - n) if room - n >= n else room
    return rows, used


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row; the other columns come along.

    ``pieces`` is read twice, for the histogram and for the ranks, so give a stored table. ``order`` fixes the
    rank of rows of equal length; rows equal in it may change places with each other. Lengths outside
    1..capacity, null among them, raise an error.
    """
    spark = pieces.sparkSession
    taken = {"sequence_id", "offset"} & set(pieces.columns)
    if taken:
        raise ValueError(f"the input has columns that packing adds: {sorted(taken)}")
    part = F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS)).cast("int")
    rows = pieces.withColumn("_len", F.col(length).cast("int")).withColumn("_part", part)
    # At most capacity x RANK_PARTS rows from here on.
    counts = rows.groupBy("_len", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["_len"]: r["n"] for r in counts.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    placed, _ = plan(histogram, capacity)
    before = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("_len").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, low, high, first, offset in placed:
        by_length.setdefault(n, []).append((low, high, first, offset))
    places = spark.createDataFrame(
        [(n, sorted(x)) for n, x in by_length.items()],
        "_l2 int, _places array<struct<low: bigint, high: bigint, first: bigint, offset: bigint>>",
    )
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_len", "_part").orderBy(*order)))
    ranked = ranked.join(bases, (F.col("_len") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_rn") - 1)
    # One row a length, at most ``capacity`` of them.
    found = ranked.join(F.broadcast(places), F.col("_len") == F.col("_l2"))
    place = F.get(F.filter("_places", lambda x: x["high"] > F.col("_rank")), F.lit(0))
    return found.withColumn("_place", place).select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("_place.first") + F.col("_rank") - F.col("_place.low")).alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from packed pieces with their ``ids``: at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
