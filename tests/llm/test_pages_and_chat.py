from __future__ import annotations

import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from variscope.llm.chat import conversations
from variscope.llm.extraction import blocks, content, extract
from variscope.llm.licences import TEMPLATES, ancestors, scan
from variscope.llm.urls import judge_urls


def wanted_verdict(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


@pytest.mark.parametrize("parts", [1, 5])
def test_url_rules_match_brute_force(spark, parts):
    rng = random.Random(9)
    labels, paths = ["com", "net", "a", "b", "a-x", "www", "é", ""], ["", "/", "/en/", "/en", "/e", "/en/x/", "/fr/"]
    host = lambda n: ".".join(rng.choice(labels[2:7] if k else labels) for k in range(n, -1, -1))
    rules = {(".".join(rng.choice(labels[:7]) for _ in range(rng.randint(1, 3))), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "http://A.Com", "x://a.com?q=/en/", "http://a.com#/en/", "http://a.com/en/://b.com/"]
    urls += [f"http{rng.choice(['', 's'])}://{host(rng.randint(0, 3)).upper()}{rng.choice(paths)}{rng.choice(['', 'page', '?x', '#y', 'x/y'])}" for _ in range(500)]
    pages = spark.createDataFrame([(i % 400, u, i) for i, u in enumerate(urls)], "page_id long, url string, k int")
    out = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=parts).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == wanted_verdict(urls[r["k"]], rules, "allow"), r


def test_of_equally_long_rules_the_longer_host_counts(spark):
    pages = spark.createDataFrame([(i, "http://a.b.com/aaaa") for i in range(20)], "page_id long, url string")
    for verdicts in (("allow", "block"), ("block", "allow")):
        rules = spark.createDataFrame([("b.com", "/aaaa", verdicts[0]), ("a.b.com", "/aa", verdicts[1])], "host string, path string, verdict string")
        assert {(r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()} == {("a.b.com/aa", verdicts[1])}


def test_url_rules_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")] * 3, "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert [r["verdict"] for r in judge_urls(pages, rules).collect()] == ["block"] * 3
    assert judge_urls(pages, rules.limit(0), default="block").filter("rule IS NULL AND verdict = 'block'").count() == 3
    assert judge_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages.withColumn("rule", F.lit(1)), rules)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header class="top"><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="cookie notice">We use cookies</div>
{list}<article><h1>Title {n}</h1><p><b>Lead  text {n}.<br><p>Second &lt;b&gt; caf&eacute;&nbsp;{n} <i>in</i>line<script>x</script></p>{share}<div class="ad">Buy {n}</div>
<form><label>Mail</label><input></form><ul><li>One {n}<li>Two <a href="#">link</a> {n}</ul><section class="comments"><p>Nice! {n}</p></section></article>
<aside>Side</aside><footer>&copy; 2024</footer></body></html>"""


def want_text(n):
    return f"Title {n}\nLead text {n}.\nSecond <b> café {n} inline\nOne {n}\nTwo link {n}"


def test_extraction_on_templates(spark):
    made = [(i, f"http://host.example/{i}", PAGE.format(n=i, list="", share="<p>Share this article</p>")) for i in range(12)]
    made += [(100 + i, f"http://small{i}.example/", PAGE.format(n=i, list="", share="")) for i in range(3)]
    made += [(200, None, None), (201, "http://host2.example/", ""), (202, "x", "plain words"), (203, "http://t.example/", "<article><p>cut in a tag <b")]
    df = spark.createDataFrame([(*m, 1) for m in made], "page_id long, url string, html string, text int")
    rows = {r["page_id"]: r for r in extract(df).collect()}
    assert len(rows) == len(made)
    for i in range(12):
        assert rows[i]["text"] == want_text(i), rows[i]["text"]  # the shared line is of the template
    for i in range(3):
        assert rows[100 + i]["text"] == want_text(i)
    assert rows[200]["text"] == "" and rows[200]["url"] is None and rows[201]["text"] == "" and rows[202]["text"] == "plain words" and rows[203]["text"] == "cut in a tag"
    assert extract(df.limit(0)).count() == 0


def test_extraction_keeps_passages_that_some_pages_share(spark):
    made = [(i, "http://h.example/x", f"<body><article><p>own {i}</p>{'<p>passage that many share</p>' if i % 3 else ''}</article></body>") for i in range(30)]
    made += [(50, "http://h.example/x", made[1][2])] * 2  # repeated pages
    rows = extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert Counter("passage" in r["text"] for r in rows) == Counter({True: 22, False: 10}) and all("own" in r["text"] for r in rows)


@pytest.mark.parametrize("copies", [7, 8, 20])
@pytest.mark.parametrize("url", ["http://h.example/x", None])
def test_copies_of_one_page_are_one_witness(spark, copies, url):
    same = "<body><article><h1>The title</h1><p>The one story.</p></article></body>"
    made = [(i, url, same) for i in range(copies)]
    # The article is the same, what stands around it is not.
    made += [(100 + i, "http://around.example/", same.replace("<article>", f"<div>Seen at {i}</div><article>")) for i in range(copies)]
    rows = extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in rows] == ["The title\nThe one story."] * (2 * copies)


def test_pages_without_text_are_no_witnesses(spark):
    made = [(i, "http://h.example/x", f"<body><div><p>We use cookies here</p></div><section><p>Story {i}</p></section></body>") for i in range(9)]
    made += [(50, "http://h.example/x", None), (51, "http://h.example/x", ""), (52, "http://h.example/x", "<body><nav>Menu</nav></body>")]
    rows = extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in rows) == ["", "", ""] + [f"Story {i}" for i in range(9)]


def test_link_lists_of_the_template_are_menus(spark):
    menu = '<div><ul><li><a href="/{n}">Topic {n}</a></li><li><a href="/b">B {n}</a></li></ul></div>'
    made = [(i, "http://h.example/", f"<body>{menu.format(n=i)}<div><p>Story {i} of <a href='/'>this</a> town</p></div></body>") for i in range(10)]
    rows = extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in rows) == sorted(f"Story {i} of this town" for i in range(10))


def test_blocks_survive_broken_markup():
    assert content("") == "" and content("</p></div>text<") == "text<"
    assert [b[3] for b in blocks("<p>a<p>b<div>c</p>d</div><!-- x <p>no</p>")] == ["a", "b", "c", "d"]
    assert content("<nav>m</nav><div hidden>h</div><p>a&amp;b &am; &#233;</p>") == "a&b &am; é"
    assert content("<p>x</p>" * 3000).count("\n") == 2999


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    assert content("<div class=x><b>" * 100_000 + "text" + "</b></div>" * 100_000) == "text"
    assert content("<p>one<div>" * 50_000 + "two").count("\n") == 50_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20


@pytest.mark.parametrize("mark", ["has-sidebar", "no-sidebar", "page-with-nav", "header-layout", "search", "related", "footer-dark", "ad-free"])
def test_a_marked_wrapper_keeps_the_article_below(mark):
    assert content(f"<body><div class='{mark}'><article><h1>T</h1><p>text</p></article></div></body>") == "T\ntext"
    assert content(f"<body><div class='x {mark}'><div><main><p>text</p></main></div></div></body>") == "text"


@pytest.mark.parametrize("mark", ["entry-header", "legal", "tags", "search", "notice", "alert", "related"])
def test_marked_parts_of_an_article_go_only_with_evidence(mark):
    page = "<body><article><div class='{}'>{}</div><p>text</p></article></body>"
    assert content(page.format(mark, "<h1>Title</h1>")) == "Title\ntext"
    assert content(page.format(mark, "<ul><li><a href='/'>More</a></li></ul>")) == "text"
    assert content("<div class='has-sidebar'><p>no article element</p></div>") == "no article element"


def test_marks_of_teasers_adverts_and_comments():
    teaser = "<div class='related'><article><p>Other story</p></article></div>"
    assert content(f"<article><p>text</p></article>{teaser}<div class='ad'><article>Buy</article></div>") == "text"
    assert content(f"<div><p>text</p></div>{teaser}") == "text\nOther story"
    assert content("<div><p>text</p></div><section class='comments'><article><p>Nice</p></article></section>") == "text"
    assert content("<article><p>See <a class='related' href='/'>this</a> <span class='notice'>now</span> and <b class='ad'>buy</b>go.</p></article>") == "See this now and go."
    assert content("<article><p>text</p><p><a class='related' href='/'>this</a></p></article>") == "text"


CHAT = [
    (1, 0, "user", "Hello there everyone\nHow do I frobnicate the widget?"),
    (1, 1, "a", "On Monday X wrote:\n> How do I frobnicate the widget?\nTurn the big handle left."),
    (1, 2, "b", "> How do I  frobnicate the WIDGET?\nNo, turn it right please."),
    (1, 3, "user", ">> How do I frobnicate the widget?\n> Turn the big handle left.\nThanks, that works"),
    (1, 4, "c", "unrelated words go here"),
    (2, 5, "q", "> nothing known here at all\r\n> x\nreply"),
    (2, 9, "q", "On Friday Y wrote:\nno quote follows"),
]


def test_quotes_link_messages(spark):
    df = spark.createDataFrame([(*m, 1) for m in CHAT], "conv_id long, turn int, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in conversations(df).collect()}
    links = {k: (r["parent"], r["linked_by"], r["thread"], r["depth"], r["position"]) for k, r in got.items()}
    assert links == {
        (1, 0): (None, "none", 0, 0, 0), (1, 1): (0, "quote", 0, 1, 1), (1, 2): (0, "quote", 0, 1, 2), (1, 3): (1, "quote", 0, 2, 3),
        (1, 4): (3, "order", 0, 3, 4), (2, 5): (None, "none", 5, 0, 0), (2, 9): (5, "order", 5, 1, 1),
    }
    assert got[1, 1]["text"] == "Turn the big handle left." and got[1, 3]["text"] == "Thanks, that works" and got[2, 5]["text"] == "reply"
    assert got[2, 9]["text"] == "On Friday Y wrote:\nno quote follows" and got[1, 3]["quoted_lines"] == 2


def plain_conversations(rows, size=5):
    """Message by message on whole passages and texts, without joins."""
    words = lambda x: re.sub(r"\s+", " ", x.lower()).strip().split(" ") if x.strip() else []
    split = lambda t: [(len(re.sub("[^>]", "", m[1])) if (m := re.match(r"^[ \t]*((?:>[ \t]?)+)", x)) else 0, re.sub(r"^[ \t]*((?:>[ \t]?)+)", "", x)) for x in re.split("\r?\n", t or "")]
    own, turns = defaultdict(list), defaultdict(set)
    for c, t, _, text in rows:
        turns[c].add(t)
        own[c, t].append(words("\n".join(b for level, b in split(text) if not level)))

    def first(c, window):
        has = lambda w: any(w[i : i + len(window)] == window for i in range(len(w) - len(window) + 1))
        return min((t for t in turns[c] if any(has(w) for w in own[c, t])), default=None)

    out = {}
    for c, t in sorted({(r[0], r[1]) for r in rows}):
        weight, seen = Counter(), set()
        for r in rows:
            if r[:2] != (c, t):
                continue
            for level, run in itertools.groupby(split(r[3]), key=lambda x: x[0]):
                w = words("\n".join(b for _, b in run))
                n = min(len(w), size)
                for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if level and n else ():
                    origin = first(c, list(window))
                    if origin is not None and origin < t and (level, window) not in seen:
                        seen.add((level, window))
                        weight[n < size, level, origin] += 1
        before = [x for x in turns[c] if x < t]
        parent = min(weight, key=lambda k: (k[0], k[1], -weight[k], -k[2]))[2] if weight else max(before, default=None)
        out[c, t] = (parent, *((out[c, parent][1], out[c, parent][2] + 1) if parent is not None else (t, 0)))
    return out


def test_rewrapped_shortened_and_nested_quotes_link(spark):
    rows = [
        (1, 0, "a", "First question about Spark joins and memory.\nSecond line goes on about broadcast limits for a while."),
        (1, 1, "b", "Answer one is here, long enough to be quoted in part later on."),
        (1, 2, "c", "> First question about Spark joins\n> and memory. Second line goes\n> on about broadcast\nyes"),
        (1, 3, "d", "On Monday X wrote:\n> Answer one is here, long\nI disagree"),
        (1, 4, "e", ">> question about\n>> Spark joins and memory\n> I disagree\nso do I"),
        (1, 5, "f", "> enough to be [...]\n> be quoted in part later\n> > nothing of this was said\nright"),
        (1, 6, "g", "> something that nobody ever said here\nwhat"),
        (1, 7, "h", "no quote " + "\x1e0\x1f" + "\n> FIRST\tquestion  about\n>\n> spark joins\nlast"),
    ]
    got = {r["turn"]: (r["parent"], r["linked_by"]) for r in conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {0: (None, "none"), 1: (0, "order"), 2: (0, "quote"), 3: (1, "quote"), 4: (0, "quote"), 5: (1, "quote"), 6: (5, "order"), 7: (0, "quote")}


def test_conversations_match_plain_python(spark):
    rng = random.Random(11)
    lines = [f"this is line number {i}" for i in range(30)] + ["short"]
    rows = []
    for c in range(12):
        for t in sorted(rng.sample(range(3000), 40 if c else 150)):
            own = "\n".join(rng.choice(lines) + (f" {c}" if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 3)))
            quotes = "\n".join(">" * rng.randint(1, 3) + " " + rng.choice(lines) for _ in range(rng.choice([0, 0, 1, 2])))
            rows.append((c, t, rng.choice("ab"), quotes + "\n" + own))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = conversations(df).collect()
    want = plain_conversations(rows)
    assert len(got) == len(rows)
    places = defaultdict(list)
    for r in got:
        assert (r["parent"], r["thread"], r["depth"]) == want[r["conv_id"], r["turn"]]
        places[r["conv_id"], r["thread"]].append((r["position"], r["turn"]))
    for p in places.values():
        p.sort()
        assert [x for x, _ in p] == list(range(len(p))) and [t for _, t in p] == sorted(t for _, t in p)


def test_short_quotes_link_when_nothing_longer_does(spark):
    rows = [
        (1, 0, "a", "ok"), (1, 1, "b", "好的。"), (1, 2, "c", "a line that is long enough"), (1, 3, "d", "> ok\nfine"), (1, 4, "e", "> 好的。\nyes"),
        (1, 5, "f", "> ok\n>> a line that is long enough\nboth"), (1, 6, "g", ">\n>  \nempty quotes"),
    ]
    got = {r["turn"]: (r["parent"], r["linked_by"], r["depth"]) for r in conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {0: (None, "none", 0), 1: (0, "order", 1), 2: (1, "order", 2), 3: (0, "quote", 1), 4: (1, "quote", 2), 5: (2, "quote", 3), 6: (5, "order", 4)}


def test_conversations_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "x", None), (2, None, "x", ""), (1, 4, "c", "same words twice"), (1, 4, "c", "same words twice"), (1, 5, None, "> same words twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = Counter((r["conv_id"], r["turn"], r["parent"], r["thread"], r["depth"], r["position"], r["text"]) for r in conversations(df).collect())
    assert got == Counter({(None, 1, None, 1, 0, 0, ""): 1, (2, None, None, None, 0, 0, ""): 1, (1, 4, None, 4, 0, 0, "same words twice"): 1, (1, 4, None, 4, 0, 1, "same words twice"): 1, (1, 5, 4, 4, 1, 2, ""): 1})
    assert conversations(df.limit(0)).count() == 0


MIT_FILE = TEMPLATES["MIT"][4] + "\nThe software is provided as is."


def test_licences_own_and_inherited(spark):
    rows = [
        ("LICENSE", "Apache License Version 2.0\nterms and conditions"), ("a/LICENSE.txt", MIT_FILE), ("a/b/x.py", "code here"), ("a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode of the file that goes on for some lines"),
        ("a/b/c/d/z.py", None), ("q/r.py", ""), ("q/r.py", ""), (None, "Released under the MIT License."), (None, "words"), ("top.py", "license"),
        ("a/e/notice_me.py", "this line speaks of a driving license for cars and trucks in the town"), ("w/only.txt", "All rights reserved."), ("w/v/x", "t"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, text string, named int")
    got = {r["named"]: (r["license"], r["how"], r["from_dir"]) for r in scan(df).collect()}
    assert got == {
        0: ("Apache-2.0", "own", None), 1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("CC-BY-NC-4.0", "own", None), 4: ("MIT", "inherited", "a"),
        5: ("Apache-2.0", "inherited", ""), 6: ("Apache-2.0", "inherited", ""), 7: ("MIT", "own", None), 8: (None, None, None), 9: ("Apache-2.0", "inherited", ""),
        10: ("MIT", "inherited", "a"), 11: ("all-rights-reserved", "own", None), 12: ("all-rights-reserved", "inherited", "w"),
    }
    assert scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan(df.withColumn("license", F.lit(1)))


def test_notices_inside_and_across_lines(spark):
    prose = "this module reads the tables of the town and counts the people who live in each of its houses before the numbers are printed again"
    rows = [
        ("a", f"{prose}. Released under the MIT License. {prose}."), ("b", "# Licensed under the Apache License,\n# Version 2.0.\ncode"), ("c", f"{prose}\n{prose}"),
        ("d/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nEveryone is permitted to copy."), ("e", "a driving license is\nneeded for cars in the town\n" + prose),
        ("f", f"{prose}, all of which is licensed under the MIT license and {prose}"),
    ]
    got = {r["path"]: r["license"] for r in scan(spark.createDataFrame(rows, "path string, text string"), file_share=2.0).collect()}
    assert got == {"a": "MIT", "b": "Apache-2.0", "c": None, "d/COPYING": "GPL-2.0", "e": None, "f": "MIT"}


def test_licence_cosines_match_plain_python(spark):
    rng = random.Random(12)
    notices = [n for texts in TEMPLATES.values() for n in texts]
    docs = []
    for i in range(120):
        n = rng.choice(notices).split(" ")
        if rng.random() < 0.5:
            n.insert(rng.randrange(len(n)), rng.choice(["license", "for", "the", "project", "word"]))
        docs.append((f"d/{i}", " ".join(n)))
    out = {r["path"]: r for r in scan(spark.createDataFrame(docs, "path string, text string"), file_share=2.0).collect()}
    terms = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    cue = re.compile(r"(?i)licen[cs]e|spdx|all rights reserved|public domain|permission is hereby|redistribution and use|creative commons|\bcc[ -]?(by|0)\b")
    found = [(p, t) for p, t in docs if cue.search(t)]
    df = Counter(w for _, t in found for w in set(terms(t)))
    df.update(w for n in notices for w in set(terms(n)))
    total = len(found) + len(notices)
    idf = {w: math.log((total + 1) / (c + 1)) + 1 for w, c in df.items()}
    vector = lambda t: {w: c * idf[w] for w, c in Counter(terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for p, t in found:
        v = vector(t)
        best = max((round(sum(x * m.get(w, 0) for w, x in v.items()) / norm(v) / norm(m), 6), name) for name, texts in TEMPLATES.items() for m in map(vector, texts))
        if best[0] >= 0.75:
            assert out[p]["license"] == best[1] and out[p]["cosine"] == pytest.approx(best[0], abs=2e-6)
        else:
            assert out[p]["license"] is None


def test_ancestors(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a",), ("",)], "d string").select(ancestors(F.col("d")).alias("x")).collect()
    assert [r["x"] for r in rows] == [["a/b/c", "a/b", "a", ""], ["a", ""], [""]]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_their_sql(spark):
    from check import connect
    from variscope.llm.queries import QUERIES, SQL

    con = connect(SF)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall()), name
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in QUERIES}
