"""Near-duplicate detection by a chosen-path set similarity join over minwise tokens.

A text becomes the set of its word shingles, hashed to 64 bits, and the set becomes ``TOKENS`` minwise
values. Every tree starts by branching the sets on the value at one place; a node that is still large
branches again on places that its own number selects. Small nodes are compared exhaustively: first by the
share of equal minwise values, which leaves groups of sets that may be similar, then on the full sets.
Equal groups of several trees are compared once. Two sets of similarity ``s`` share a given branching with
probability ``s``, so at 0.8 a tree misses a pair with at most 0.2 at the root and ``0.2 ** BRANCHES`` at
every further level, and ten trees miss less than one pair in 10,000 even at the fourth level.

The first tree runs alone and its links are closed to components. In the other trees a node whose sets are
all of one component has nothing left to find and is dropped, and compared sets of one component count as
linked, so a large group of similar texts gives few links.

Texts with equal sets are one vertex from the start, so copies cost a row each and no comparison. Links are
exact: only the search for candidates is randomised, and its numbers are fixed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.llm.components import components
from variscope.llm.scratch import stored

TOKENS = 64
TREES = 10
BRANCHES = 2
DEPTH = 4
#: Sets of a node that are compared exhaustively in one task. Larger nodes branch; after DEPTH levels their
#: pairs are compared block by block, so no pair of a node is left out.
NODE_SETS = 2048
#: Shingles of the full sets that one task compares at once; larger teams meet block by block.
TEAM_SHINGLES = 1 << 23
#: A pair is compared on full sets if its estimate falls short of the threshold by no more than this: five
#: standard deviations of the estimate from 64 values at 0.8.
MARGIN = 0.25
REMEMBERED_WORDS = 1_000_000


class _WordHash(dict):
    """64-bit hashes of words, made on first use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingler(width: int):
    """A function from text bytes to the sorted distinct 64-bit hashes of its shingles."""
    import numpy as np

    known = _WordHash()
    odd = np.random.Generator(np.random.PCG64(20)).integers(1 << 62, 1 << 63, width + 1, np.uint64) * np.uint64(2) + np.uint64(1)

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def shingles(text: bytes):
        words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        k = min(width, n)
        h = np.full(n - k + 1, int(odd[width]) * k % (1 << 64), np.uint64)
        for j in range(k):
            h += mixed(w[j : n - k + 1 + j]) * odd[j]
        return np.unique(mixed(h))

    return shingles


def minwise(tokens: int):
    """A function from a set of hashes to its minwise values, 32 bits each."""
    import numpy as np

    g = np.random.Generator(np.random.PCG64(21))
    a = g.integers(1, 1 << 63, tokens, np.uint64) * np.uint64(2) + np.uint64(1)
    b = g.integers(0, 1 << 63, tokens, np.uint64)

    def values(found):
        out = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 8192):
            x = (found[at : at + 8192, None] ^ b[None, :]) * a[None, :]
            np.minimum(out, x.min(axis=0), out=out)
        return (out >> np.uint64(32)).astype("<u4")

    return values


def _bytes(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def sketches(docs: DataFrame, key: str, text: str, width: int, tokens: int = TOKENS) -> DataFrame:
    """key, n_shingles, vertex (128-bit digest of the set), tokens (minwise values); both null for an empty set."""
    import pyarrow as pa

    kind = docs.schema[key].dataType

    def run(batches):
        import xxhash

        shingles, values = shingler(width), minwise(tokens)
        for batch in batches:
            n, vertex, marks = [], [], []
            for t in _bytes(batch.column(1)):
                found = shingles(t)
                n.append(len(found))
                vertex.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                marks.append(values(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(vertex, pa.binary()), pa.array(marks, pa.binary())], ["key", "n_shingles", "vertex", "tokens"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("n_shingles", T.LongType()), T.StructField("vertex", T.BinaryType()), T.StructField("tokens", T.BinaryType())])
    return docs.select(key, text).mapInArrow(run, schema)


def full_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, vertex, found (the sorted hashes of the set as bytes), each set once a task."""
    import pyarrow as pa

    kind = docs.schema[key].dataType

    def run(batches):
        import xxhash

        shingles, seen = shingler(width), set()
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                found = shingles(t).tobytes()
                vertex = xxhash.xxh3_128_digest(found)
                if found and (vertex, k) not in seen:
                    seen.add((vertex, k))
                    rows.append((k, vertex, found))
            keys, vertices, sets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(vertices, pa.binary()), pa.array(sets, pa.binary())], ["key", "vertex", "found"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("vertex", T.BinaryType()), T.StructField("found", T.BinaryType())])
    return docs.select(key, text).mapInArrow(run, schema)


def _token(place: Column) -> Column:
    return F.substr(F.col("tokens"), place * 4 + 1, F.lit(4))


def paths(sets: DataFrame, trees: range, branches: int = BRANCHES, depth: int = DEPTH, node_sets: int = NODE_SETS, tokens: int = TOKENS) -> DataFrame:
    """``node``, ``vertex``, ``label`` for all nodes that are small enough to compare, blocks included.

    Nodes hold sets of two labels at least: those of one label are linked already.
    """
    roots = F.transform(F.array(*[F.lit(t) for t in trees]), lambda t: F.xxhash64(t, _token(t % tokens)))
    frontier = sets.select("vertex", "label", F.explode(roots).alias("node"))
    small = []
    for level in range(depth + 1):
        sizes = frontier.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high")
        counted = stored(frontier.join(sizes.select("node", "n"), "node").select("node", "vertex", "label", "n"), "nodes")
        small.append(counted.filter(F.col("n") <= node_sets).select("node", "vertex", "label"))
        large = counted.filter(F.col("n") > node_sets)
        if large.isEmpty():
            break
        if level == depth:
            # Block by block: each set meets every block of its node, two blocks at a time.
            blocks = F.ceil(F.col("n") * 2 / node_sets).cast("int")
            own = large.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("vertex"), F.col("_blocks")).cast("int"))
            other = own.select("node", "vertex", "label", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
            small.append(other.select(F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("node"), "vertex", "label"))
        else:
            picks = F.transform(F.sequence(F.lit(0), F.lit(branches - 1)), lambda b: F.pmod(F.xxhash64(F.col("node"), b), F.lit(tokens)).cast("int"))
            child = F.transform(picks, lambda p: F.xxhash64(F.col("node"), p, _token(p)))
            # Picks may agree; a node's children are told apart by place and value, so equal ones are one.
            frontier = large.join(sets.select("vertex", "tokens"), "vertex").select("vertex", "label", F.explode(F.array_distinct(child)).alias("node"))
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out


def grouped(rows, columns: int):
    """Runs of equal first column over Arrow batches sorted by it: the value and the other columns as lists."""
    at, held = None, [[] for _ in range(columns - 1)]
    for batch in rows:
        cols = [c.to_pylist() for c in batch.columns]
        for n, g in enumerate(cols[0]):
            if g != at:
                if at is not None:
                    yield at, held
                at, held = g, [[] for _ in range(columns - 1)]
            for mine, col in zip(held, cols[1:], strict=True):
                mine.append(col[n])
    if at is not None:
        yield at, held


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def likely_groups(nodes: DataFrame, sets: DataFrame, least_equal: int, tokens: int = TOKENS) -> DataFrame:
    """``team``, ``vertex``: sets of one node joined by estimates; equal teams of several nodes have one number."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import xxhash

        teams, vertices = [], []
        for _, (vertex, marks) in grouped(batches, 3):
            n = len(vertex)
            m = np.frombuffer(b"".join(marks), "<u4").reshape(n, tokens)
            forest = Forest(n)
            for i in range(n - 1):
                for j in np.flatnonzero((m[i + 1 :] == m[i]).sum(axis=1) >= least_equal):
                    forest.join(i, i + 1 + int(j))
            parts: dict[int, list[bytes]] = {}
            for i in range(n):
                parts.setdefault(forest.root(i), []).append(vertex[i])
            for part in parts.values():
                if len(part) > 1:
                    team = xxhash.xxh3_128_digest(b"".join(sorted(part)))
                    teams += [team] * len(part)
                    vertices += part
            if len(teams) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(teams, pa.binary()), pa.array(vertices, pa.binary())], ["team", "vertex"])
                teams, vertices = [], []
        if teams:
            yield pa.RecordBatch.from_arrays([pa.array(teams, pa.binary()), pa.array(vertices, pa.binary())], ["team", "vertex"])

    rows = nodes.join(sets.select("vertex", "tokens"), "vertex").select("node", "vertex", "tokens")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "team binary, vertex binary").distinct()


def in_blocks(teams: DataFrame, bound: int) -> DataFrame:
    """Teams (team, vertex, label, n_shingles) of more shingles than ``bound`` as teams of two blocks each, so that any two sets still meet."""
    sizes = teams.groupBy("team").agg(F.ceil(F.sum("n_shingles") * 2 / bound).cast("int").alias("n"))
    blocks = F.when(F.col("n") <= 2, 1).otherwise(F.col("n"))
    own = teams.join(sizes, "team").withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("vertex"), F.col("_n")).cast("int"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).filter("_n = 1 OR _own <> _other")
    pair = F.concat_ws(",", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return met.select(F.concat("team", F.encode(pair, "UTF-8")).alias("team"), "vertex", "label")


def links(teams: DataFrame, sets: DataFrame, percent: int, kind: T.DataType) -> DataFrame:
    """``a``, ``b``: labels linked by pairs confirmed on full sets, as many as it takes to connect what is linked in a team."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field(1).type
        left, right = [], []

        def all_batches():
            yield first
            yield from batches

        for _, (labels, found) in grouped(all_batches(), 3):
            n = len(labels)
            if len(set(labels)) == 1:
                continue
            arrays = [np.frombuffer(x, np.uint64) for x in found]
            sizes = np.array([len(x) for x in arrays])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            values, inverse = np.unique(np.concatenate(arrays), return_inverse=True)
            mark = np.zeros(len(values), bool)
            forest, known = Forest(n), {}
            for i, label in enumerate(labels):
                forest.join(known.setdefault(label, i), i)
            for i in range(n - 1):
                mine = inverse[starts[i] : starts[i] + sizes[i]]
                mark[mine] = True
                from_ = starts[i + 1]
                common = np.add.reduceat(mark[inverse[from_:]], starts[i + 1 :] - from_, dtype=np.int64)
                mark[mine] = False
                for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[i + 1 :] - common)):
                    if forest.join(i, i + 1 + int(j)):
                        left.append(labels[i])
                        right.append(labels[i + 1 + int(j)])
            if len(left) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(left, key_type), pa.array(right, key_type)], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, key_type), pa.array(right, key_type)], ["a", "b"])

    rows = teams.join(sets, "vertex").select("team", "label", "found")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return rows.repartition("team").sortWithinPartitions("team").mapInArrow(run, schema)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    trees: int = TREES,
    node_sets: int = NODE_SETS,
    depth: int = DEPTH,
    team_shingles: int = TEAM_SHINGLES,
) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; their sets hold the distinct shingles of
    ``width`` words, or the whole sequence of a shorter text. Two texts are linked if their sets overlap by at
    least ``percent`` of their union. ``component_id`` is the least key reachable over links, ``kept`` marks
    the rows that have it themselves. Texts without words, null ones too, are linked with nothing. Rows with a
    null key are left out of the linking: their component is null and they are kept. Repeated keys are one
    document for the links found. Other columns are left out.
    """
    kind = docs.schema[key].dataType
    rows = stored(sketches(docs, key, text, width), "sketches")
    usable = rows.filter("key IS NOT NULL AND vertex IS NOT NULL")
    # One document stands for all with an equal set.
    classes = stored(usable.groupBy("vertex").agg(F.min("key").alias("rep")), "classes")
    chosen = usable.join(classes.select(F.col("vertex").alias("_v"), F.col("rep").alias("_rep")), (F.col("vertex") == F.col("_v")) & (F.col("key") == F.col("_rep")), "left_semi")
    sets = stored(chosen.select("vertex", "key", "tokens", "n_shingles").dropDuplicates(["vertex"]).withColumn("label", F.col("key")), "sets")
    least_equal = max(1, int(TOKENS * max(0.0, percent / 100 - MARGIN)))
    numbers = range(trees)
    for some in [x for x in (numbers[:1], numbers[1:]) if x]:
        teams = stored(likely_groups(paths(sets, some, depth=depth, node_sets=node_sets), sets, least_equal), "teams")
        wanted = stored(sets.join(teams, "vertex", "left_semi").select("key").distinct(), "wanted")
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key", "left_semi")
        named = in_blocks(teams.join(sets.select("vertex", "label", "n_shingles"), "vertex"), team_shingles)
        closed = components(links(named, full_sets(texts, "key", "text", width), percent, kind))
        closed = closed.select(F.col("vertex").alias("_from"), F.col("component").alias("_to"))
        sets = sets.join(closed, F.col("label") == F.col("_from"), "left").select("vertex", "key", "tokens", "n_shingles", F.coalesce("_to", "label").alias("label"))
        if some[-1] < trees - 1:
            sets = stored(sets, "sets")
    labels = sets.select(F.col("vertex").alias("_v"), "label")
    members = rows.select("key", "n_shingles", "vertex").join(labels, F.col("vertex") == F.col("_v"), "left")
    component = F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("label", "key"))
    return members.select(F.col("key").alias(key), "n_shingles", component.cast(kind).alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
