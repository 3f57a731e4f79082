from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from variscope.llm.exact_dedup import deduplicate, directory, hashes
from variscope.llm.near_dedup import in_blocks, near_duplicates, shingler
from variscope.llm.quality import Rule, judge
from variscope.llm.scratch import stored

WORD = re.compile(r"[^ \t-\r]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def texts(rng):
    vocabulary = ["the", "of", "and", "Haus", "été", "x", "co***", "a b", "😀", "|"]
    out = [None, "", " \n\t\x0b", "a a a a a", "a b c a b c d", "line\nline\n line\nline", "word " * 3000]
    for _ in range(150):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\r\n", "\t"]) for _ in range(rng.randint(0, 90))))
    return out


def test_quality_counts_match_plain_python(spark):
    docs = texts(random.Random(1))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = judge(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"]) and (r["kept"] or r["base_failed"] or r["failed_rules"])


def test_quality_keeps_prose_and_other_columns(spark):
    prose = "the king of the hill and his men went to a town that is by the sea with a wall " * 1 + " ".join(f"word{i} of tale{i}" for i in range(60))
    junk = " ".join(f"w{i}### the" for i in range(60))
    df = spark.createDataFrame([(1, prose, "a"), (1, prose, "a"), (2, junk, None), (None, None, "b")], "doc_id long, text string, extra string")
    rows = judge(df).collect()
    assert [(r["doc_id"], r["kept"], r["extra"]) for r in rows] == [(1, True, "a"), (1, True, "a"), (2, False, None), (None, False, "b")]
    assert judge(df).filter("kept").count() == 2 and judge(df.limit(0)).count() == 0
    assert judge(df, rules=()).filter("kept").count() == 3
    with pytest.raises(ValueError):
        judge(df, rules=(Rule("x", "no_such_measure", 0, 1),))
    with pytest.raises(ValueError):
        judge(df.withColumnRenamed("extra", "kept"))


def exact_expected(docs):
    groups = defaultdict(list)
    for k, t in docs:
        groups[lowered(t)].append(k)
    return groups


@pytest.mark.parametrize(("rows", "buckets"), [(1024, 65536), (8, 65536), (1, 4)])
def test_exact_dedup_splits_pages_and_compares(spark, rows, buckets):
    rng = random.Random(2)
    pool = [None, "", "A Text", "a text", "É", "é", "y" * 40000] + [f"document {i}" for i in range(120)]
    docs = [(i, rng.choice(pool)) for i in range(300)] + [(1000 + i, "Hot COPY" if i % 2 else "hot copy") for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = deduplicate(df, bucket_rows=rows, max_buckets=buckets).collect()
    groups = exact_expected(docs)
    want = {(k, max(ks), len(ks), k == max(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks}
    assert len(out) == len(docs) and {tuple(r) for r in out} == want


def test_exact_dedup_directory_covers_all_hashes(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(500)] + [("same",)] * 100, "text string")
    keys = stored(hashes(df, "text"), "keys")
    found = directory(keys, 16, 1 << 16)
    assert found[0].start == 0 and [b.start for b in found] == sorted({b.start for b in found})
    assert all(b.start + (1 << (64 - b.depth)) == c.start for b, c in zip(found, found[1:], strict=False)) and found[-1].start + (1 << (64 - found[-1].depth)) == 1 << 64
    assert sum(b.pages > 1 for b in found) == 1 and max(b.pages for b in found) >= 6


def test_exact_dedup_nulls_repeats_and_empty(spark):
    docs = [(None, "a"), (3, "A"), (3, "a"), (None, "q"), (None, "Q"), (7, None), (8, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, keep_id int")
    for rows in (1024, 1):
        out = deduplicate(df, bucket_rows=rows).collect()
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out)
        assert got == Counter([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, None, 2, True), (None, None, 2, False), (7, 8, 2, False), (8, 8, 2, True)])
    assert deduplicate(df.limit(0)).count() == 0


def near_expected(docs, width, percent):
    sets = {}
    for k, t in docs:
        w = WORD.findall(lowered(t))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), root(k), root(k) == k) for k in keys}


def near_corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 and docs:
            w = list(rng.choice(docs))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.5:
            w = passage + rng.choices(vocabulary, k=rng.randint(0, 6))
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 4, 60, 90, 200]))
        docs.append(w)
    return [(i, rng.choice([" ", "\n", "  "]).join(w).upper() if i % 3 else " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize(("width", "node_sets", "depth", "shingles"), [(4, 512, 4, 1 << 23), (4, 8, 3, 300), (5, 4, 1, 100)])
def test_near_dedup_matches_brute_force(spark, width, node_sets, depth, shingles):
    docs = near_corpus(random.Random(width * 10 + depth), 260)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = near_duplicates(df, width=width, percent=80, node_sets=node_sets, depth=depth, team_shingles=shingles).collect()
    assert {tuple(r) for r in out} == near_expected(docs, width, 80) and len(out) == len(docs)


def test_near_dedup_dense_group_in_small_nodes(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = f"r{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = near_duplicates(df, width=4, percent=80, node_sets=16, depth=2).collect()
    assert {tuple(r) for r in out} == near_expected(docs, 4, 80)


@pytest.mark.parametrize("bound", [10, 64, 500])
def test_large_teams_meet_in_blocks_of_bounded_size(spark, bound):
    teams = spark.createDataFrame([(b"t" * 16, b"%015d" % i, i, 1 + i % 3) for i in range(120)] + [(b"u" * 16, b"x", 1, 2), (b"u" * 16, b"y", 2, 2)], "team binary, vertex binary, label long, n_shingles long")
    met = defaultdict(set)
    for r in in_blocks(teams, bound).collect():
        met[bytes(r["team"])].add(r["label"] if r["team"][:1] == b"t" else -r["label"])
    pairs = {(a, b) for m in met.values() for a in m for b in m if a < b}
    assert {(a, b) for a in range(120) for b in range(a + 1, 120)} <= pairs and (-2, -1) in pairs
    assert len(met) == 2 if bound == 500 else max(sum(1 + x % 3 for x in m) for m in met.values()) < 4 * bound


def test_near_dedup_nulls_repeats_and_empty(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = [(5, words), (5, words), (9, words.upper()), (None, words), (2, None), (3, ""), (4, " \n"), (6, "one"), (7, "One ")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int")
    out = Counter(tuple(r) for r in near_duplicates(df, width=4).collect())
    assert out == Counter([(5, 27, 5, True), (5, 27, 5, True), (9, 27, 5, False), (None, 27, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (6, 1, 6, True), (7, 1, 6, False)])
    assert near_duplicates(df.limit(0)).count() == 0


def test_shingles_cut_at_ascii_space_only():
    shingles = shingler(2)
    assert len(shingles("a b c\x1cd".encode())) == 1 and len(shingles(b"A b\x0bc")) == 2
    assert list(shingles(b"A B c")) == list(shingles(b"a b C"))
