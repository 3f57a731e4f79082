from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from variscope.llm import collocations as C
from variscope.llm import decontamination as D
from variscope.llm import resampling as R

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return ALNUM.findall(lower(text))


def small(monkeypatch, **settings):
    for name, value in settings.items():
        monkeypatch.setattr(D if hasattr(D, name) else R if hasattr(R, name) else C, name, value)


# The FM-index


def plain_suffixes(text):
    order = lambda i: [(0, i + n) if c == 0 else (1, c) for n, c in enumerate(text[i:])]
    return sorted(range(len(text)), key=order)


@pytest.mark.parametrize("letters,length,seed", [(1, 40, 0), (2, 60, 1), (3, 200, 2), (70, 300, 3), (2, 1, 4)])
def test_suffix_array_and_searches_match_brute_force(letters, length, seed):
    rng = random.Random(seed)
    text = [0 if rng.random() < 0.1 else rng.randint(1, letters) for _ in range(length)] + [0]
    array = np.array(text, np.int32)
    assert D.suffix_array(array).tolist() == plain_suffixes(text)
    starts = np.array([i for i, c in enumerate(text) if c and (i == 0 or text[i - 1] == 0)] or [0])
    levels = max(letters, 1).bit_length()
    vocabulary = b" ".join(b"%d" % i for i in range(1, letters + 1))
    index = D.Index(len(text), vocabulary, np.bincount(array, minlength=letters + 1).astype("<u4").tobytes(), *D.index_arrays(array, starts, levels))
    phrases = [[rng.randint(1, letters) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    matrix = np.array([[0] * (4 - len(p)) + p for p in phrases])
    matrix[7, 3] = -1  # an unknown word
    which, low, high = index.find(matrix)
    found = defaultdict(list)
    for w, places in D.located(index, which, low, high) if len(which) else []:
        for n, p in zip(w.tolist(), places.tolist(), strict=True):
            found[n].append(p)
    for n, p in enumerate(phrases):
        want = [i for i in range(len(text)) if n != 7 and text[i : i + len(p)] == p]
        assert sorted(found[n]) == want, (n, p)


def plain_contamination(docs, items, width):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    out = []
    for key, text in docs:
        w, hit, named = alnum(text), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return out


def random_texts(rng, n, words=("a", "B", "c1", "é", "Ñu", "日本"), longest=40):
    return [" ".join(rng.choice(words) + rng.choice(["", "", ",", ". ", "\n-"]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("shard_words,shard_docs,block_words,located", [(1 << 20, 1 << 16, 1 << 20, 1 << 20), (25, 1 << 16, 60, 7), (64, 2, 1 << 20, 100)])
def test_contamination_matches_brute_force(spark, monkeypatch, shard_words, shard_docs, block_words, located):
    small(monkeypatch, SHARD_WORDS=shard_words, SHARD_DOCS=shard_docs, BLOCK_WORDS=block_words, LOCATED=located)
    rng = random.Random(shard_words)
    items = [(i, t) for i, t in enumerate(random_texts(rng, 12, longest=9))] + [(3, "A b c1 A"), (50, None), (51, "..."), (None, "c1 c1 c1"), (52, "É é")]
    docs = [(i, t) for i, t in enumerate(random_texts(rng, 60, longest=60))]
    docs += [(100, None), (101, ""), (102, "?!"), (3, docs[3][1]), (None, "c1 c1 c1 c1"), (103, " ".join(["a B"] * 300)), (104, "x " * 500 + "c1 C1 c1")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, row int").repartition(3)
    got = D.contamination(df, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, number string"), width=4).collect()
    want = plain_contamination(docs, items, 4)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        ends = [(s["from"], s["to"]) for s in r["spans"]]
        assert sum(b - a for a, b in ends) == r["n_hit"] and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_contamination_of_empty_tables_and_cut_spans(spark):
    docs = spark.createDataFrame([(1, "One two, THREE four five."), (2, None), (3, "-- three Four --"), (4, "three four"), (5, "éa three. four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "three four")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in D.contamination(docs, items.limit(0)).collect()} == {0}
    found = D.contamination(docs, items).join(docs, "doc_id").withColumn("left", D.without_spans(F.col("text"), F.col("spans")))
    assert {r["doc_id"]: r["left"] for r in found.collect()} == {1: "One two,  five.", 2: None, 3: "--  --", 4: "", 5: "éa "}


# Collocations


def plain_collocations(docs, longest, least):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(p) and b >= a and inside(q) for (x, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("chunk,seed", [(12 << 20, 1), (300, 2)])
def test_collocations_match_brute_force(spark, monkeypatch, chunk, seed):
    small(monkeypatch, CHUNK_BYTES=chunk)
    rng = random.Random(seed)
    words = ["of", "The", "the", "x-y", "é", "(a", "日本", "rare"]
    text = lambda: "".join(rng.choice(words[: rng.randint(2, 8)]) + rng.choice([" ", " ", "\t ", ". ", ",", "\x0b", " ; "]) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(120)]
    docs += [("en", None), ("en", ""), ("fr", " . , "), ("en", "of the " * 400), (None, "x.of"), ("", "of the of the of the of the of the of the")] + docs[:5]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "lang string, text string, prefix int, f string").repartition(4)
    got = C.collocations(df, longest=5, min_count=5)
    assert sorted((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()) == plain_collocations(docs, 5, 5)
    top = C.best(got, 3).collect()
    want = defaultdict(list)
    for x in sorted(plain_collocations(docs, 5, 5), key=lambda x: (-x[6], -x[2], x[1].encode())):
        want[x[0]].append(x[1])
    assert {(r["lang"], r["rank"], r["phrase"]) for r in top} == {(lg, n + 1, p) for lg, ps in want.items() for n, p in enumerate(ps[:3])}


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_007
    phrases = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big + 9), ("en", ["a", "b"], big - 5)], "lang string, words array<string>, f long")
    row = C.cut_scores(phrases, spark.createDataFrame([("en", 10**16 + 1)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 5) * (10**16 + 1) // (big * (big + 9))


def test_the_bitmap_holds_every_frequent_phrase(spark):
    lists = [["a", "b"], ["é", "日本"], ["x"]]
    known = C.bitmap(spark.createDataFrame([("en", w) for w in lists], "lang string, words array<string>"))
    for words in lists:
        h = zlib.crc32(b"en") % C.HASH_PRIME
        for w in words:
            h = (h * C.HASH_BASE + zlib.crc32(w.encode())) % C.HASH_PRIME
        assert known.holds(np.array([h % C.BITMAP_BITS]))[0]
    assert int(np.bitwise_count(known.bits).sum()) == 3


# Resampling


def plain_resample(docs, target, percent, min_words, longest, buckets, seed):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [alnum(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        f = grams(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = total // len(f) if f else 0
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(alnum(text)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], n + 1) for n, r in enumerate(able[: len(able) * percent // 100])]
    return sorted(drawn), sorted([r[:4] for r in rows], key=str)


@pytest.mark.parametrize("longest,percent,step", [(1, 10, 64), (2, 35, 6), (3, 100, 64), (1, 0, 64)])
def test_resampling_matches_brute_force(spark, monkeypatch, longest, percent, step):
    small(monkeypatch, STEP=step, SORTED_AT_ONCE=20)
    rng = random.Random(longest)
    docs = [(i, t) for i, t in enumerate(random_texts(rng, 200, words=[f"w{i}" for i in range(40)]))] + [(1000, None), (1001, ""), (5, "w1 w2 w3 w4 w5 w6"), (1002, "w1 " * 5000)]
    target = [*random_texts(rng, 20, words=[f"w{i}" for i in range(10)]), None]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int").repartition(5)
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 6, longest, 97).collect()
    drawn, rows = plain_resample(docs, target, percent, 6, longest, 97, R.SEED)
    assert sorted(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got if r["rank"] is not None) == drawn
    assert sorted([tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in got], key=str) == rows


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_ranks_with_ties_nulls_and_a_hot_key(spark, monkeypatch, ranges):
    small(monkeypatch, STEP=8, SORTED_AT_ONCE=30)
    rng = random.Random(7)
    rows = [(rng.randint(0, 4), rng.choice([1, 2, 3, None]), i) for i in range(400)] + [(2, 2, i) for i in range(300)] + [(None, 1, 0)] * 3
    out = R.ranked(spark.createDataFrame(rows, "score int, doc_id int, i int").repartition(6), "score", "doc_id", ranges).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, len(rows) + 1))
    key = lambda r: (r["score"] is None, -(r["score"] or 0), r["doc_id"] is None, r["doc_id"] or 0)
    assert [key(r) for r in sorted(out, key=lambda r: r["rank"])] == sorted(map(key, out))


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(docs, docs.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = R.resample(one, docs.select("text")).first()
    assert (row["n_features"], row["rank"]) == (3, None)
    with pytest.raises(ValueError):
        R.resample(one, one, percent=101)
