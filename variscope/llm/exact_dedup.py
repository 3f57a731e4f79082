"""Exact deduplication with an extendible-hash index on shared files.

Texts are indexed by a 64-bit hash. A directory maps hash ranges to buckets; an overfull bucket is split by
its next bit, which doubles the directory there, until every bucket fits. Rows of one hash cannot be split
by it: such a bucket gets overflow pages, over which its rows are dealt. Owner tasks take whole buckets or
pages in hash order, chain the different texts of one hash and compare bytes. What they find is written to
the shared folder; keys with several pages are then joined through one row for each page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.llm.scratch import stored

#: Rows of a bucket or page, and the most buckets a directory may have; larger tables get larger buckets.
BUCKET_ROWS = 1024
MAX_BUCKETS = 65_536
STEP_BITS = 4


@dataclass(frozen=True)
class Bucket:
    start: int  # the first hash, unsigned
    depth: int  # how many leading bits its hashes share
    pages: int


def text_hash(normalised: bytes) -> tuple[int, str]:
    """The first 8 bytes of SHA-256 as an unsigned number, and its hex digits."""
    import hashlib

    digest = hashlib.sha256(normalised)
    return int.from_bytes(digest.digest()[:8], "big"), digest.hexdigest()


def _lowered(column):
    """Texts with A-Z lower-cased, as bytes; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.ascii_lower(pc.fill_null(column, "")).cast(pa.binary()).to_pylist()


def hashes(docs: DataFrame, text: str) -> DataFrame:
    """One 64-bit hash a row, as a signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([text_hash(x)[0] for x in _lowered(batch.column(0))], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return docs.select(text).mapInArrow(run, "h long")


def directory(keys: DataFrame, bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> list[Bucket]:
    """Buckets in hash order for a stored table of hashes ``h``.

    The driver holds counts of hash ranges, at most a few for each bucket, and buckets are at most about twice
    ``max_buckets``. Each round looks only into ranges that are still overfull.
    """
    total = keys.count()
    room = max(bucket_rows, -(-total // max_buckets))
    depth = max(1, min(63, (max(total, 1) // room).bit_length() + 2))
    out: list[Bucket] = []
    done, wanted = 0, None  # bits looked at, and the overfull ranges
    while True:
        prefix = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - depth))
        rows = keys
        if wanted is not None:
            spots = keys.sparkSession.createDataFrame([(p,) for p in wanted], "_p long")
            rows = keys.withColumn("_p", F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - done))).join(F.broadcast(spots), "_p", "left_semi")
        cells = {r["p"]: (r["n"], r["low"] == r["high"]) for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).collect()}
        again: list[int] = []

        def split(at: int, bits: int, inside: list[int], cells=cells, again=again, depth=depth) -> None:
            rows_here = sum(cells[p][0] for p in inside)
            if rows_here <= room:
                out.append(Bucket(at << (64 - bits), bits, 1))
            elif len(inside) == 1 and (cells[inside[0]][1] or depth == 63):  # one hash alone: overflow pages
                out.append(Bucket(at << (64 - bits), bits, -(-rows_here // room)))
            elif bits == depth and depth < 63:
                again.append(at)
            else:
                middle = (2 * at + 1) << (depth - bits - 1)
                split(2 * at, bits + 1, [p for p in inside if p < middle])
                split(2 * at + 1, bits + 1, [p for p in inside if p >= middle])

        by_root: dict[int, list[int]] = {}
        for p in cells:
            by_root.setdefault(p >> (depth - done), []).append(p)
        for at in [0] if wanted is None else wanted:
            split(at, done, by_root.get(at, []))
        if not again:
            return sorted(out, key=lambda b: b.start)
        done, wanted, depth = depth, again, min(63, depth + STEP_BITS)


def indexed(docs: DataFrame, buckets: list[Bucket], key: str, text: str) -> DataFrame:
    """Index entries, one a row of ``docs``: unit, h, link, key, keep, size, first, paged, text_sha256, head.

    ``unit`` is a bucket's page, ``link`` the place of a text in the chain of its hash. ``keep`` and ``size``
    hold inside the unit; ``first`` marks the one row that stays there. ``head`` has the bytes of a text, once
    for each page of a bucket with several pages.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType
    starts, pages = [b.start for b in buckets], [b.pages for b in buckets]

    def deal(batches):
        import numpy as np

        first = np.array(starts, np.uint64)
        many = np.array(pages, np.int64)
        base = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
        seen = 0
        for batch in batches:
            texts = _lowered(batch.column(1))
            both = [text_hash(x) for x in texts]
            h = np.array([x[0] for x in both], np.uint64)
            at = np.searchsorted(first, h, "right") - 1
            place = seen + np.arange(len(h))  # rows of one hash are dealt in turn, so repeated keys part too
            seen += len(h)
            unit = base[at] + place % many[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(unit), pa.array(h.view(np.int64)), pa.array(many[at] > 1), pa.array([x[1] for x in both]), pa.array(texts, pa.binary())],
                ["k", "unit", "h", "paged", "sha", "body"],
            )

    def own(batches):
        at, chain, rows = None, [], []  # the hash at hand, its different texts, its rows
        out: list[tuple] = []

        def close():
            for n, (link, k, sha, paged) in enumerate(rows):
                body, keep, size, winner = chain[link]
                out.append((k, at[0], at[1], link, keep, size, n == winner, paged, sha, body if n == winner and paged else None))

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            types = [key_type, pa.int64(), pa.int64(), pa.int32(), key_type, pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.name for f in schema])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, unit, h, paged, sha, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, h) != at:
                    if at is not None:
                        close()
                    at, chain, rows = (unit, h), [], []
                for link, x in enumerate(chain):
                    if x[0] == body:
                        break
                else:
                    link = len(chain)
                    chain.append([body, k, 0, len(rows)])
                x = chain[link]
                x[2] += 1
                if x[1] is None and k is not None or k is not None and k > x[1]:
                    x[1], x[3] = k, len(rows)
                rows.append((link, k, sha, paged))
            if len(out) >= 4096:
                yield flush()
        if at is not None:
            close()
        if out:
            yield flush()

    dealt = T.StructType([T.StructField("k", kind)] + [T.StructField(n, t) for n, t in (("unit", T.LongType()), ("h", T.LongType()), ("paged", T.BooleanType()), ("sha", T.StringType()), ("body", T.BinaryType()))])
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("unit", T.LongType()), T.StructField("h", T.LongType()), T.StructField("link", T.IntegerType()), T.StructField("keep", kind)]
        + [T.StructField(n, t) for n, t in (("size", T.LongType()), ("first", T.BooleanType()), ("paged", T.BooleanType()), ("text_sha256", T.StringType()), ("head", T.BinaryType()))]
    )
    owned = docs.select(key, text).mapInArrow(deal, dealt).repartition("unit").sortWithinPartitions("unit", "h")
    return owned.mapInArrow(own, schema)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest key
    stays, a null key being the smallest; of repeated rows with that key one stays. Other columns are left out.
    """
    keys = stored(hashes(docs, text), "dedup-keys")
    buckets = directory(keys, bucket_rows, max_buckets)
    if not buckets:
        buckets = [Bucket(0, 0, 1)]
    index = stored(indexed(docs, buckets, key, text), "dedup-index")
    alone = index.filter(~F.col("paged")).select(key, F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    # One row for each text and page; texts are compared as bytes by grouping on them.
    same = Window.partitionBy("h", "head")
    heads = index.filter("paged AND head IS NOT NULL")
    merged = heads.select(
        F.col("unit").alias("_unit"),
        F.col("h").alias("_h"),
        F.col("link").alias("_link"),
        F.max("keep").over(same).alias("keep_id"),
        F.sum("size").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("keep").desc_nulls_last(), "unit")) == 1).alias("_wins"),
    )
    paged = index.filter("paged").join(merged, (F.col("unit") == F.col("_unit")) & (F.col("h") == F.col("_h")) & (F.col("link") == F.col("_link")))
    return alone.unionByName(paged.select(key, "keep_id", "group_size", (F.col("first") & F.col("_wins")).alias("kept"), "text_sha256"))
