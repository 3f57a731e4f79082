from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from variscope.llm.mixing import mix, mixed_documents, sized
from variscope.llm.packing import cut, encoder, pack, plan, sequences, tokenize
from variscope.llm.scratch import stored
from variscope.llm.sharding import shards

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^ \t-\r]+")


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [0]


def test_word_by_word_ids_are_those_of_the_whole_text():
    encode = encoder(PATH, 0)
    rng = random.Random(3)
    marks = ["the", "été", "don't", "I'll", "12", "a1b2", "x.", "(y)", "<|endoftext|>", "ß,", "...", "日本", "😀!", "naïve?", " z", "", "_w", "'s", "A"]
    cases = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "<|endoftext|>", "a<|endoftext|> b"]
    cases += ["".join(rng.choice(marks) + rng.choice([" ", " ", " ", "\n", "  ", "\t", ""]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    for t in cases:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole_ids(t), repr(t)


@pytest.mark.parametrize("blanks", [" ", "\n", "\t", " \n\t", "\u3000"])
def test_millions_of_blanks_are_encoded(spark, blanks):
    text = "a" + blanks * (2_000_000 // len(blanks)) + "b c"
    ids = whole_ids(text)
    assert np.frombuffer(encoder(PATH, 0)(text), "<u4").tolist() == ids
    if blanks == " ":
        pieces = tokenize(spark.createDataFrame([(1, text), (2, "d")], "doc_id int, text string"), PATH).orderBy("doc_id", "piece").collect()
        assert np.frombuffer(b"".join(p["ids"] for p in pieces if p["doc_id"] == 1), "<u4").tolist() == ids


def test_only_the_first_piece_is_short():
    assert list(cut(5, 4)) == [(0, 1), (1, 4)] and list(cut(8, 4)) == [(0, 4), (4, 4)] and list(cut(3, 4)) == [(0, 3)]


def checked(rows, used, counts, capacity):
    held = defaultdict(list)
    ranks = defaultdict(list)
    for n, low, high, first, offset in rows:
        ranks[n].append((low, high))
        for i in range(high - low):
            held[first + i].append((offset, n))
    for n, c in counts.items():
        at = 0
        for low, high in sorted(ranks[n]):
            assert low == at
            at = high
        assert at == c
    assert sorted(held) == list(range(used))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2


def test_plan_is_gapless_and_tight():
    rng = random.Random(4)
    for capacity in (1, 2, 3, 10, 100, 2048):
        for _ in range(25):
            counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 40))}
            rows, used = plan(counts, capacity)
            checked(rows, used, counts, capacity)
            total = sum(n * c for n, c in counts.items())
            big = sum(c for n, c in counts.items() if 2 * n > capacity)
            assert used >= max(-(-total // capacity), big)
            assert used <= max(-(-total // capacity), big) * 1.25 + 1
    assert plan({6: 3, 4: 3, 5: 2}, 10)[1] == 4


def test_packing_round_trip(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "wörter", "the"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(120)] + [(7, None), (7, None), (None, "x y")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, offset int")
    pieces = stored(tokenize(df, PATH, capacity=32), "pieces")
    packed = stored(pack(pieces, ["doc_id", "piece"], capacity=32), "packed")
    rows = packed.collect()
    assert len(rows) == pieces.count()
    joined = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences(packed).collect()}
    assert all(len(ids) <= 32 for ids in joined.values())
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids and len(ids) == r["length"]
        by_doc[r["doc_id"]].append((r["start"], r["piece"], ids))
    for i, t in docs[:120]:
        if i != 7:
            parts = sorted(by_doc[i])
            assert [p for _, p, _ in parts] == list(range(len(parts))) and sum((x for *_, x in parts), []) == whole_ids(t)
    assert sum(len(p) for p in joined.values()) == sum(r["length"] for r in rows)
    assert pack(pieces.limit(0), ["doc_id", "piece"], 32).count() == 0
    with pytest.raises(ValueError):
        pack(pieces.withColumn("length", F.lit(None).cast("long")), ["doc_id"], 32)


def aims(sizes, weights=(3, 1, 2)):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        new = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in order}
        full |= new


def corpus(rng, n=300):
    sources = ["hot", "hot", "hot", "b", "c", "ä", None, "tiny"]
    return [(i, rng.choice(["", "  "]) + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 10, 40, 200]))) if rng.random() > 0.03 else None, rng.choice(sources)) for i in range(n)]


def test_mixing_meets_its_targets(spark):
    docs = corpus(random.Random(6)) + [(5000, "lone word", "only"), (5001, None, "void"), (3, "again and again", "b"), (3, "again and again", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    segments = mix(sized(df), block_words=64)
    first = segments.orderBy("slot", "id", "from_word").collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mix(sized(df.repartition(7)), block_words=64).collect()), key=str)
    sizes, taken = Counter(), Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    per_doc = defaultdict(list)
    for r in first:
        if r["slot"] is not None:
            taken[r["source"]] += r["to_word"] - r["from_word"]
            assert 0 <= r["from_word"] < r["to_word"] <= r["size"]
            per_doc[r["sid"], tuple(r["place"]), r["pass"]].append((r["from_word"], r["to_word"]))
        assert r["source_size"] == sizes[r["source"]]
    for spans in per_doc.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    want = aims(sizes)
    for r in first:
        assert r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert len({(r["sid"], tuple(r["place"])) for r in first}) == len(docs)
    # Every start of the mixture holds the sources in their shares.
    slots = sorted({(r["slot"], r["source"]) for r in first if r["slot"] is not None}, key=lambda x: x[0])
    half = slots[: len(slots) // 2]
    share = sum(s == "hot" for _, s in half) / len(half)
    assert abs(share - want["hot"] / sum(want.values())) < 0.1
    assert mix(sized(df.limit(0))).count() == 0


def test_mixed_documents_cut_and_repeat(spark):
    docs = [d for d in corpus(random.Random(7)) if d[0] != 3] + [(3, "x y z", "b")] * 3
    df = spark.createDataFrame([(*d, len(d[1] or ""), "e") for d in docs], "doc_id long, text string, source string, n_chars long, extra string")
    out = mixed_documents(df, block_words=16)
    assert out.columns == df.columns
    rows = out.collect()
    originals = defaultdict(set)
    for i, t, _ in docs:
        originals[i].add(t)
    taken, sizes = Counter(), Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    cut_off = 0
    for r in rows:
        w = WORD.findall(r["text"])
        taken[r["source"]] += len(w)
        (whole,) = originals[r["doc_id"]]
        cut_off += r["text"] != whole
        assert r["text"] in whole and WORD.findall(whole)[: len(w)] == w and r["n_chars"] == len(r["text"])
    want = aims(sizes)
    assert cut_off <= 2 * len(sizes) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert max(Counter(r["doc_id"] for r in rows if r["doc_id"] != 3).values()) <= 2 and sum(r["doc_id"] == 3 for r in rows) <= 6


def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(8)
    docs = [(i, "ä" * rng.randrange(40)) for i in range(400)] + [(7, "same"), (7, "same"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = df.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    out = shards(rows, ["doc_id", "crc", "size"], n_shards=16).collect()
    assert Counter((r["doc_id"], r["size"], r["crc"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert set(by) == set(range(16))
    sums = [sum(r["size"] for r in by[k]) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in out)
    last = -1
    for k in range(16):
        part = sorted(by[k], key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in part]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    assert shards(rows.limit(0), ["doc_id"]).count() == 0
    one = shards(rows.limit(1), ["doc_id"]).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]
