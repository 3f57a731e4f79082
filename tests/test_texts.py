from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from variscope.operators import articles as T
from variscope.operators import grounding as G


def test_sentiment_and_topics(spark):
    rows = [("Outage and lawsuit", "weak quarter"), ("Record growth", "fiber launch"), ("Nothing", "here")]
    got = T.decorate(spark.createDataFrame(rows, "title string, snippet string")).collect()
    assert [r["sentiment"] for r in got] == ["negative", "positive", "neutral"]
    assert got[0]["tags"] == ["operations", "regulatory/legal", "financial"] and got[2]["tags"] == []


def test_articles_are_normalized_and_deduplicated(spark):
    rows = [
        (1, "", "https://www.site.com/a", None, "20240105123000", "s", "active"),
        (2, "B", "", "x", None, "s", "active"),
        (3, "C", "https://www.site.com/a", "x", "2024-01-06T10:11:12Z", "", "passive"),
    ]
    df = spark.createDataFrame(rows, "row_idx int, title string, url string, source string, published_raw string, snippet string, angle string")
    out = T.articles_normalize(df).orderBy("row_idx").collect()
    assert [(r["title"], r["source"], r["published_at"], r["snippet"]) for r in out] == [
        ("Untitled article", "site.com", "2024-01-05", "s"), ("C", "x", "2024-01-06 10:11:12", "C"),
    ]
    assert [r["row_idx"] for r in T.dedupe_keep_first(T.articles_normalize(df)).collect()] == [1]


def test_summary_counts_articles_once(spark):
    rows = [("active", "negative", ["a", "b"]), ("active", "positive", []), ("passive", "negative", ["b"])]
    row = T.article_summary(spark.createDataFrame(rows, "angle string, sentiment string, tags array<string>")).first()
    assert (row["active_count"], row["passive_count"], row["negatives"], row["positives"]) == (2, 1, 2, 1)
    assert row["tone"] == "risk-heavy" and row["top_tags"] == "b, a"


@pytest.mark.parametrize("seed", range(4))
def test_mentions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé.-") for _ in range(rng.randint(1, 4)))
    texts = [(i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 25)))) for i in range(40)]
    values = sorted({rng.choice(["", " "]) + " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice(["", " "]) for _ in range(60)})
    values += ["A" + values[0], "  "]
    docs = spark.createDataFrame(texts, "id int, body string")
    terms = spark.createDataFrame([(v,) for v in values], "term string")
    expected = {(i, v) for i, t in texts for v in values if v.strip() and v.lower() in t.lower()}
    got = {tuple(r) for r in T.mention_join(docs, "body", "id", terms, "term").collect()}
    assert got == expected
    assert T.mention_join(docs.limit(0), "body", "id", terms, "term").count() == 0 and T.mention_join(docs, "body", "id", terms.limit(0), "term").count() == 0


def test_mentions_shuffle_surroundings_and_not_texts(spark):
    docs = spark.createDataFrame([(i, "the " * 300 + f"quick brown{i % 7} fox the") for i in range(60)], "id int, body string")
    terms = spark.createDataFrame([("the quick brown3",), ("X the the",), ("the the",), ("he",)], "term string")
    found = T.mention_join(docs, "body", "id", terms, "term")
    got = found.groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in got} == {"the quick brown3": sum(i % 7 == 3 for i in range(60)), "the the": 60, "he": 60}
    shuffled = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert shuffled and not any("_text" in x or "body" in x for x in shuffled)


def test_why_factor_parts(spark):
    rows = [(1, "West outage", "u", "x", None, "active"), (2, "competitor discount", "v", "y", "2025-03-05", "passive")]
    df = spark.createDataFrame(rows, "row_idx int, title string, url string, snippet string, published_at string, angle string")
    months = spark.createDataFrame([("2025-03",)], "month string")
    scored = T.why_factor_score(
        T.decorate(df.withColumn("published_at", F.col("published_at").cast("date"))), months, ["region", "West"], "opex", "unfavorable", ["competition/pricing"]
    )
    got = {r["row_idx"]: r for r in scored.collect()}
    # 13.5 topic + 8 driver + 4 undated + 16 negative + 12 direct = 53.5, rounded up
    assert got[1]["score"] == 54 and got[1]["confidence"] == "medium"
    # 8 hinted topic + 16 month + 9 neutral + 10 market + 9 competition
    assert got[2]["score"] == 52
    assert [r["row_idx"] for r in T.top_why_factors(scored).collect()] == [1, 2]
    assert T.topic_hints(["sales_channel", "legal_entity"]) == ["competition/pricing", "regulatory/legal"]


def test_intents_and_tools(spark):
    rows = [("Can I trust the data?",), ("Compare West vs East",), ("Which driver matters in the quarter?",), ("hello",)]
    df = spark.createDataFrame(rows, "q string").select(G.intent_tag(F.col("q")).alias("i"), G.tool_plan(F.col("q")).alias("t"))
    got = df.collect()
    assert [r["i"] for r in got] == ["quality", "compare", "time", "unknown"]
    assert got[0]["t"][2:] == ["get_data_quality"] and got[2]["t"][2:] == ["get_time_analysis", "scan_dimensions"]
    assert got[3]["t"][2:] == ["get_time_analysis", "scan_dimensions"]


def test_evidence_lookup_is_limited_in_ledger_order(spark):
    rows = [("r", f"driver:{i}", "driver", i) for i in range(10)] + [("r", "scope:1", "scope", 0), ("r", "variance:1", "variance", 1)]
    got = G.evidence_for_kinds(spark.createDataFrame(rows, "run_id string, evidence_id string, kind string, seq int"), "tool")
    per = {r["tool"]: r["count"] for r in got.groupBy("tool").count().collect()}
    assert per["scan_dimensions"] == 8 and per["find_interactions"] == 5 and per["get_current_scope"] == 1


def test_grounding_matches_brute_force(spark):
    rng = random.Random(1)
    piece = lambda: rng.choice(["$1,200", "12%", "-3.5", "7K", "x", "due to", "1200", "99", "3", ".5", "and 12k", "+4", "2024-01-05"])
    rows = [(f"r{i % 3}", i, "external-context" if i % 7 == 0 else "scope", " ".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    evidence = spark.createDataFrame(rows, "run_id string, position int, kind string, text string")
    answers = evidence.select("run_id", F.col("position").alias("answer_id"), "position", F.col("text").alias("answer"), F.col("run_id").alias("calculation_run_id"))
    import re

    got = {(r["run_id"], r["answer_id"]): r for r in G.grounding_check(answers, evidence).collect()}
    for run, pos, _, text in rows:
        tokens = {re.sub(r"[$,]", "", t).lower() for t in re.findall(r"[-+]?\$?\d[\d,.]*(?:%|[KMBT])?", text, re.I)}
        before = [r for r in rows if r[0] == run and r[1] < pos]
        source = " ".join(r[3] for r in before).lower()
        missing = [t for t in tokens if t not in source]
        row = got[(run, pos)]
        assert (row["numeric_tokens"], row["unsupported_numbers"]) == (len(tokens), len(missing))
        external = any(r[2] == "external-context" for r in before)
        assert row["causality_guardrail"] == (not (external and "due to" in text))
        assert row["evidence_references"] == bool(before) and row["run_linkage"]


def test_unknown_evidence(spark):
    ledger = spark.createDataFrame([("r", "e1")], "run_id string, evidence_id string")
    claims = spark.createDataFrame([("r", "e1", "c1"), ("r", "e2", "c2"), ("q", "e1", "c3")], "run_id string, evidence_id string, claim_id string")
    assert {r["claim_id"] for r in G.unknown_evidence(claims, ledger).collect()} == {"c2", "c3"}


RUN = "run-1"


def _claim_tables(spark):
    from variscope.operators.claims import RESPONSE

    responses = spark.createDataFrame(
        [
            (RUN, "good", [("c1", ["e1", "e2"])], [("scan", ["e1"])], [("region", [("channel", "Web")])]),
            (RUN, "empty claim", [("c1", ["e1"]), ("c2", []), ("c3", None)], None, None),
            (RUN, "unknown", [("c1", ["e1", "e9", "e1", None])], [("scan", []), ("trend", ["e8"])], [(None, [("secret", "x"), ("region", "y")]), ("secret", None), ("", [])]),
            (RUN, "nothing", [], None, []),
            ("run-2", "other run", [("c1", ["e1"])], None, None),
            (None, "no run", [("c1", ["e1"])], None, None),
        ],
        RESPONSE,
    )
    ledger = spark.createDataFrame([(RUN, "e1"), (RUN, "e1"), (RUN, "e2"), ("run-2", "e7"), (None, "e1"), (RUN, None)], "run_id string, evidence_id string")
    allowed = spark.createDataFrame([(RUN, "region"), (RUN, "channel")], "run_id string, dimension string")
    return responses, ledger, allowed


def test_claims_traces_and_drills_are_resolved(spark):
    from variscope.operators.claims import claim_check, claim_errors

    tables = _claim_tables(spark)
    errors = {(r["answer_id"], r["part"], r["at"], r["name"], r["ref_at"], r["ref"], r["error"]) for r in claim_errors(*tables).collect()}
    assert errors == {
        ("empty claim", "claim", 1, "c2", None, None, "claim_without_evidence"),
        ("empty claim", "claim", 2, "c3", None, None, "claim_without_evidence"),
        ("unknown", "claim", 0, "c1", 1, "e9", "claim_unknown_evidence"),
        ("unknown", "claim", 0, "c1", 3, None, "claim_unknown_evidence"),
        ("unknown", "tool", 1, "trend", 0, "e8", "tool_unknown_evidence"),
        ("unknown", "predicate", 0, "secret", 0, "secret", "predicate_disallowed_dimension"),
        ("unknown", "action", 1, "secret", None, "secret", "action_disallowed_dimension"),
        ("other run", "claim", 0, "c1", 0, "e1", "claim_unknown_evidence"),
        ("no run", "claim", 0, "c1", 0, "e1", "claim_unknown_evidence"),
    }
    rows = {r["answer_id"]: r for r in claim_check(*tables).collect()}
    assert len(rows) == 6 and [k for k, r in rows.items() if r["valid"]] == ["good", "nothing"]
    assert rows["good"]["references"] == 5 and rows["unknown"]["references"] == 8 and rows["nothing"]["claims"] == 0
    assert (rows["empty claim"]["claims_without_evidence"], rows["unknown"]["unknown_in_claims"]) == (2, 2)


def test_grounding_takes_the_verdict_on_claims(spark):
    from variscope.operators.claims import claim_check
    from variscope.operators.grounding import grounding_check

    responses, ledger, allowed = _claim_tables(spark)
    answers = responses.select("run_id", "answer_id", F.lit(5).alias("position"), F.lit("up 12").alias("answer"), F.col("run_id").alias("calculation_run_id"))
    evidence = ledger.dropna().select("run_id", F.lit(1).alias("position"), F.lit("scope").alias("kind"), F.lit("12 rows").alias("text"))
    rows = {r["answer_id"]: r for r in grounding_check(answers, evidence, claim_check(responses, ledger, allowed)).collect()}
    assert rows["good"]["passed"] and rows["good"]["score"] == 100
    assert not rows["unknown"]["evidence_references"] and rows["unknown"]["numeric_grounding"] and rows["unknown"]["score"] == 75


def test_long_tokens_in_long_digit_runs(spark):
    rng = random.Random(6)
    digits = "".join(rng.choice("0123456789") for _ in range(30_000))
    starts = [rng.randrange(25_000) for _ in range(50)]
    inside = [digits[i : i + 1 + n] for n, i in enumerate(starts)] + [digits[5:3000], digits]
    outside = [digits[i : i + 20] + "x" for i in (0, 50)] + ["1" * 30, digits[100:140][::-1], digits + "1", digits[:9] + digits[20:29]]
    outside = [t.replace("x", "7" if digits[digits.find(t[:-1]) + 20] != "7" else "8") for t in outside]
    answers = spark.createDataFrame(
        [("r", i, 9, t, "r") for i, t in enumerate(inside + outside)] + [("other", 1000, 9, inside[30], "other")],
        "run_id string, answer_id int, position int, answer string, calculation_run_id string",
    )
    evidence = spark.createDataFrame([("r", 3, "scope", f"first 12 {digits} and"), ("r", 4, "scope", None), ("other", 3, "scope", "nothing 5")], "run_id string, position int, kind string, text string")
    got = {r["answer_id"]: r["unsupported_numbers"] for r in G.grounding_check(answers, evidence).collect()}
    assert {i for i, n in got.items() if n == 0} == set(range(len(inside)))


def test_tokens_of_all_lengths_match_a_plain_search(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("12,.") for _ in range(n))
    texts = [(rng.choice("ab"), p, f"x {number(rng.randint(1, 40))} y {number(rng.randint(1, 25))}%") for p in range(60)]
    answers = [(rng.choice("ab"), i, rng.randint(0, 60), f"{rng.choice('+-$ ')}{rng.choice('12')}{number(rng.randint(0, 14))}") for i in range(200)]
    a = spark.createDataFrame([(r, i, p, t, r) for r, i, p, t in answers], "run_id string, answer_id int, position int, answer string, calculation_run_id string")
    e = spark.createDataFrame([(r, p, "scope", t) for r, p, t in texts], "run_id string, position int, kind string, text string")
    tokens = {r["answer_id"]: r["t"] for r in a.select("answer_id", G.number_tokens(F.col("answer")).alias("t")).collect()}
    got = {r["answer_id"]: r["unsupported_numbers"] for r in G.grounding_check(a, e).collect()}
    for run, i, p, _ in answers:
        want = sum(not any(r == run and q < p and t in text for r, q, text in texts) for t in tokens[i])
        assert got[i] == want, (run, i, p, tokens[i])


def test_articles_become_context_of_the_periods_they_precede(spark):
    from datetime import date

    from variscope.operators.evidence import dataset_evidence, external_evidence
    from variscope.sources.files import content_fingerprint

    days = [("a", 1, date(2025, 1, 31)), ("b", 2, date(2025, 3, 1)), ("c", 3, date(2025, 3, 31)), ("d", 4, date(2025, 4, 1)), ("e", 5, date(2025, 3, 31)), ("f", 6, None)]
    articles = spark.createDataFrame(days, "title string, row_idx int, published_at date")
    periods = spark.createDataFrame(
        [("W", date(2025, 3, 1), date(2025, 3, 31)), ("W", date(2025, 3, 1), date(2025, 3, 31)), ("E", date(2025, 5, 1), date(2025, 5, 31)), ("E", date(2030, 1, 1), date(2030, 1, 31))],
        "segment string, period_start date, period_end date",
    )
    got = {r["evidence_id"]: r for r in external_evidence(articles, periods, "run", "segment").collect()}
    assert {k: r["summary"] for k, r in got.items()} == {
        "external-context:run:W:2025-03-01": "Untrusted hypothesis material: 4 articles, the latest of 2025-03-31",
        "external-context:run:E:2025-05-01": "Untrusted hypothesis material: 1 articles, the latest of 2025-04-01",
    }
    assert '"latest_title":"e"' in got["external-context:run:W:2025-03-01"]["payload"]
    assert external_evidence(articles.limit(0), periods, "run", "segment").count() == 0
    row = dataset_evidence(content_fingerprint(articles), "News", "run").first()
    assert row["kind"] == "dataset" and row["summary"].startswith("6 rows; content hash ")


def test_short_mentions_do_not_multiply_the_texts(spark):
    """A value of one character stands in every word: what is dealt for it is itself, once a text."""
    body = " ".join(f"e{i}e" for i in range(60))
    sentence = " ".join(f"e{i}e" for i in range(10, 40))
    texts = spark.createDataFrame([(k, f"{body} {k}") for k in range(20)], "id int, text string")
    values = spark.createDataFrame([("E",), (sentence,), ("e3e e4e",), ("e5e e6e e7e",)], "value string")
    got = {(r["id"], r["value"]) for r in T.mention_join(texts, "text", "id", values, "value").collect()}
    assert got == {(k, v) for k in range(20) for v in ("E", sentence, "e3e e4e", "e5e e6e e7e")}
    listed = values.select(F.lower("value").alias("_low"), "value")
    lowered = texts.select("id", F.lower("text").alias("_text"))
    words = lowered.select(F.explode(F.split("_text", " ")).alias("_word")).groupBy("_word").agg(F.count("*").alias("_n"))
    anchored = T._anchored(words, listed).localCheckpoint()
    spans = anchored.groupBy("_shape").agg(F.max("_before").alias("before"), F.max("_after").alias("after")).collect()
    bits = T._bits(anchored)
    assert T._spelled_met(lowered, "id", "gram", bits).count() == 20
    met = T._runs_met(lowered, "id", [s for s in spans if s["_shape"] != "gram"], bits)
    size = met.agg(F.sum(F.length("_around"))).first()[0]
    assert size <= texts.agg(F.sum(F.length("text"))).first()[0]


@pytest.mark.parametrize("parts", [T.PART_VALUES, -1])
def test_mentions_of_short_and_long_lists(spark, monkeypatch, parts):
    """A list that can be broadcast is searched in generated code, without a lambda a word; a longer one by runs."""
    monkeypatch.setattr(T, "PART_VALUES", parts)
    texts = [(1, "The quick\nBrown fox jumps"), (1, "the QUICK\nbrown fox"), (None, "a quick brown fox jumps"), (2, ""), (3, None), (4, "éx fox\n fox")]
    values = ["quick\nbrown", "X j", "the quick\nbrown fox", "\nb", "É", " fox ", "\n fox", "brown cat jumps", "quick brown fox jumps", "rown", None, " \n", "X j"]
    docs = spark.createDataFrame(texts, "id int, body string")
    found = T.mention_join(docs, "body", "id", spark.createDataFrame([(v,) for v in values], "term string"), "term")
    expected = {(i, v) for i, t in texts for v in values if t and v and v.strip() and v.lower() in t.lower()}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and {v for _, v in expected} >= {"X j", "\nb", "É", " fox ", "\n fox"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    if parts > 0:
        assert "BroadcastHashJoin" in plan and "lambda" not in plan
