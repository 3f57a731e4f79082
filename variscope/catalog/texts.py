"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, query
from variscope.functions import words
from variscope.operators import articles as T
from variscope.operators import grounding as G
from variscope.operators.semantics import DIMENSION_CATALOG, resolve_dimension
from variscope.sources.warehouse import articles, fact, table


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def hit_sql(text, items) -> str:
    return f"len(list_filter({sql_list(items)}, lambda w: contains({text}, w)))"


ARTICLES = """art AS (SELECT doc_id AS row_idx, split_part(text, chr(10), 1) AS title, 'http://' || source || '/' || doc_id AS url, source, DATE '1998-01-01' + cast(doc_id AS INTEGER) AS published_at, text AS snippet,
  CASE WHEN lang = 'en' THEN 'active' ELSE 'passive' END AS angle, lower(split_part(text, chr(10), 1) || ' ' || text) AS low FROM documents)"""
TAGS = "list_filter([" + ", ".join(
    f"CASE WHEN {hit_sql('low', terms)} > 0 THEN '{tag}' END" for tag, terms in words.TOPICS.items()
) + "], lambda x: x IS NOT NULL)"
DECORATED = f"""{ARTICLES}, dec AS (SELECT *, {hit_sql('low', words.POSITIVE_WORDS)} AS pos, {hit_sql('low', words.NEGATIVE_WORDS)} AS neg, {TAGS} AS tags FROM art),
art2 AS (SELECT *, CASE WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive' ELSE 'neutral' END AS sentiment FROM dec)"""

# Words of the invented prose in place of a company vocabulary, for queries that need many hits.
PROSE = ("ther", "tion", "nen", "ent", "der", "que")


@query(
    "articles_normalize",
    """SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'Untitled article') AS title, url,
    coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), ''), 'news source') AS source,
    CASE WHEN url LIKE 'https:%' THEN cast(DATE '2024-01-01' + cast(page_id AS INTEGER) AS VARCHAR) ELSE cast(DATE '2024-01-01' + cast(page_id AS INTEGER) AS VARCHAR) || ' 08:30:00' END AS published_at FROM pages WHERE url <> ''""",
)
def articles_normalize(spark, sf):
    p = table(spark, sf, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int"))
    raw = F.when(F.col("url").startswith("https:"), F.date_format(day, "yyyyMMddHHmmss")).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:30:00Z"))
    )
    df = p.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.lit("").alias("source"),
        raw.alias("published_raw"), F.lit("").alias("snippet"), F.lit("active").alias("angle"),
    )
    return T.articles_normalize(df).select("page_id", "title", "url", "source", "published_at")


@query("sentiment_tag", f"WITH {DECORATED} SELECT row_idx, sentiment FROM art2")
def sentiment_tag(spark, sf):
    return T.decorate(articles(spark, sf)).select("row_idx", "sentiment")


@query("topic_tags", f"WITH {DECORATED} SELECT row_idx, array_to_string(tags, ',') AS tags FROM art2")
def topic_tags(spark, sf):
    return T.decorate(articles(spark, sf)).select("row_idx", F.array_join("tags", ",").alias("tags"))


@query(
    "dedupe_keep_first",
    """WITH a AS (SELECT doc_id AS row_idx, split_part(text, chr(10), 1) AS title, CASE WHEN lang = 'en' THEN '' ELSE 'http://' || source END AS url FROM documents)
    SELECT row_idx, title, url FROM a QUALIFY row_number() OVER (PARTITION BY CASE WHEN url = '' THEN lower(title) ELSE url END ORDER BY row_idx) = 1""",
)
def dedupe_keep_first(spark, sf):
    d = table(spark, sf, "documents")
    df = d.select(
        F.col("doc_id").alias("row_idx"), F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("http://"), "source")).alias("url"),
    )
    return T.dedupe_keep_first(df)


@query(
    "union_all",
    """WITH a AS (SELECT doc_id // 2 AS row_idx, 'http://' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN lang ELSE '' END AS url, CASE WHEN doc_id % 2 = 1 THEN 'active' ELSE 'passive' END AS angle FROM documents)
    SELECT row_idx, url, angle FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY angle, row_idx) = 1) ORDER BY angle, row_idx LIMIT 40""",
)
def union_all(spark, sf):
    d = table(spark, sf, "documents").select(
        F.expr("doc_id div 2").alias("row_idx"), F.lit("").alias("title"),  # numbered apart in each search
        F.concat(F.lit("http://"), "source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise("")).alias("url"),
        F.when(F.col("doc_id") % 2 == 1, "active").otherwise("passive").alias("angle"),
    )
    return T.union_all(d.filter("angle = 'active'"), d.filter("angle = 'passive'"), T.MAX_ARTICLES).select("row_idx", "url", "angle")


@query(
    "article_summary",
    f"""WITH {DECORATED}, c AS (SELECT count(*) FILTER (WHERE angle = 'active') AS active_count, count(*) FILTER (WHERE angle = 'passive') AS passive_count, count(*) FILTER (WHERE sentiment = 'positive') AS positives,
      count(*) FILTER (WHERE sentiment = 'negative') AS negatives FROM art2),
    t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM art2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)
    SELECT *, CASE WHEN negatives > positives THEN 'risk-heavy' WHEN positives > negatives THEN 'opportunity-leaning' ELSE 'mixed/neutral' END AS tone, (SELECT coalesce(string_agg(tag, ', ' ORDER BY n DESC, tag), '') FROM t) AS top_tags FROM c""",
)
def article_summary(spark, sf):
    return T.article_summary(T.decorate(articles(spark, sf)))


@query(
    "timing_overlap",
    f"WITH {FACT}, {ARTICLES} SELECT row_idx, strftime(published_at, '%Y-%m') AS month FROM art WHERE strftime(published_at, '%Y-%m') IN (SELECT strftime(period_date, '%Y-%m') FROM fact WHERE returnflag = 'R')",
)
def timing_overlap(spark, sf):
    rows = fact(spark, sf, ["period_date", "returnflag"]).filter("returnflag = 'R'")
    return T.timing_overlap(articles(spark, sf), rows, "period_date").select("row_idx", "month")


@query(
    "mention_join",
    "SELECT DISTINCT doc_id, b.text AS value FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))",
)
def mention_join(spark, sf):
    return T.mention_join(table(spark, sf, "documents"), "text", "doc_id", table(spark, sf, "benchmark"), "text")


@query(
    "mention_join_long_list",
    """WITH v AS (SELECT DISTINCT trim(w) AS value FROM (SELECT unnest(string_split(text, '.')) AS w FROM benchmark) WHERE trim(w) <> '')
    SELECT DISTINCT doc_id, value FROM documents d JOIN v ON contains(lower(d.text), lower(value))""",
)
def mention_join_long_list(spark, sf):
    values = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\.")).alias("w")).select(F.btrim("w", F.lit(" ")).alias("value"))
    return T.mention_join(table(spark, sf, "documents"), "text", "doc_id", values.filter("value <> ''"), "value")


def _why_sql(lens, direction, drivers, hints):
    weights = {**{h: words.HINTED_WEIGHT for h in hints}, **words.LENS_WEIGHTS[lens]}
    case = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {words.OTHER_WEIGHT} END"
    tone = {
        "unfavorable": "CASE sentiment WHEN 'negative' THEN 16 WHEN 'positive' THEN 6 ELSE 9 END",
        "favorable": "CASE sentiment WHEN 'positive' THEN 14 WHEN 'negative' THEN 5 ELSE 8 END",
    }[direction]
    full = "low || ' ' || array_to_string(tags, ' ')"
    return f"""WITH {FACT}, {DECORATED}, months AS (SELECT DISTINCT strftime(period_date, '%Y-%m') AS month FROM fact WHERE returnflag = 'R'),
    x AS (SELECT *, CASE WHEN len(tags) > 0 THEN tags ELSE ['market context'] END AS topics, strftime(published_at, '%Y-%m') AS month FROM art2),
    y AS (SELECT row_idx, least(28, 10 * list_sum(list_transform(topics, lambda t: {case}))) AS topic_score, least(22, 8 * {hit_sql('(' + full + ')', drivers)}) AS driver_score,
      CASE WHEN month IN (SELECT month FROM months) THEN 16 ELSE 8 END AS time_score, {tone} AS direction_score, CASE WHEN angle = 'active' THEN 12 ELSE 10 END AS angle_score,
      CASE WHEN angle = 'passive' AND list_contains(topics, 'competition/pricing') THEN 9 ELSE 0 END AS boost FROM x),
    z AS (SELECT *, cast(least(100, floor(topic_score + driver_score + time_score + direction_score + angle_score + boost + 0.5)) AS INTEGER) AS score FROM y)
    SELECT row_idx, round(cast(topic_score AS DOUBLE), 6) AS topic_score, cast(driver_score AS INTEGER) AS driver_score, time_score, direction_score, score,
      CASE WHEN score >= 72 THEN 'high' WHEN score >= 48 THEN 'medium' ELSE 'low' END AS confidence FROM z"""


HINTS = T.topic_hints(["supplier", "product_brand", "price_band"])


def _why(spark, sf):
    months = fact(spark, sf, ["period_date", "returnflag"]).filter("returnflag = 'R'").select(T.month_key(F.col("period_date")).alias("month"))
    scored = T.why_factor_score(T.decorate(articles(spark, sf)), months, PROSE, "opex", "unfavorable", HINTS)
    return scored.select(
        "row_idx", F.round("topic_score", 6).alias("topic_score"), F.col("driver_score").cast("int").alias("driver_score"),
        "time_score", "direction_score", "score", "confidence",
    )


@query("why_factor_score", _why_sql("opex", "unfavorable", PROSE, HINTS))
def why_factor_score(spark, sf):
    return _why(spark, sf)


@query("top_why_factors", _why_sql("opex", "unfavorable", PROSE, HINTS) + " ORDER BY score DESC, row_idx LIMIT 8")
def top_why_factors(spark, sf):
    return T.top_why_factors(_why(spark, sf))


INTENT_CASE = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{n}'" for n, p in words.INTENTS) + " ELSE 'unknown' END"
TOOL_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{n}' END" for n, p in words.TOOL_PATTERNS) + "], lambda x: x IS NOT NULL)"


@query("intent_tag", f"SELECT intent, count(*) AS turns FROM (SELECT {INTENT_CASE} AS intent FROM (SELECT lower(text) AS q FROM conversations WHERE role = 'user')) GROUP BY 1")
def intent_tag(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    return users.groupBy(G.intent_tag(F.col("text")).alias("intent")).agg(F.count("*").alias("turns"))


@query(
    "tool_plan",
    f"""SELECT conv_id, turn, array_to_string({sql_list(words.BASE_TOOLS)} || CASE WHEN len(t) > 0 THEN t ELSE {sql_list(words.GENERAL_TOOLS)} END, ',') AS tools
    FROM (SELECT conv_id, turn, {TOOL_LIST} AS t FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'))""",
)
def tool_plan(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.array_join(G.tool_plan(F.col("text")), ",").alias("tools"))


ASKED = ["month", "region", "deviceOs", "offer", "planType", "ageBand", "supportTier"]
NAMED_CASE = "CASE " + " ".join(
    f"WHEN {hit_sql('q', [w.lower() for w in (name, label, *more)])} > 0 THEN '{name}'" for name, label, _, more in DIMENSION_CATALOG if name in ASKED
) + " END"


@query("resolve_dimension", f"SELECT conv_id, turn, {NAMED_CASE} AS dimension FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations)")
def resolve_dimension_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", resolve_dimension(F.col("text"), ASKED).alias("dimension"))


def grounding_sql(answers, evidence):
    causal = " OR ".join(f"regexp_matches(answer, '(?i){p}')" for p in words.CAUSAL_PATTERNS)
    return f"""WITH a AS ({answers}), e AS ({evidence}),
    tk AS (SELECT run_id, answer_id, position, unnest(list_distinct(list_transform(regexp_extract_all(answer, '(?i)[-+]?\\$?\\d[\\d,.]*(?:%|[KMBT])?'), lambda x: lower(regexp_replace(x, '[$,]', '', 'g'))))) AS token FROM a),
    pr AS (SELECT DISTINCT run_id, position, token FROM tk),
    -- one scan per distinct question: is the token in any earlier text of the run?
    ok AS (SELECT DISTINCT pr.run_id, pr.position, pr.token FROM pr JOIN e ON e.run_id = pr.run_id AND e.position < pr.position AND contains(lower(e.text), pr.token)),
    un AS (SELECT tk.run_id, tk.answer_id, count(*) AS numeric_tokens, count(*) FILTER (WHERE ok.token IS NULL) AS unsupported_numbers FROM tk LEFT JOIN ok ON ok.run_id = tk.run_id AND ok.position = tk.position AND ok.token = tk.token GROUP BY 1, 2),
    b AS (SELECT run_id, min(position) AS f, min(position) FILTER (WHERE kind = 'external-context') AS x FROM e GROUP BY 1),
    c AS (SELECT a.run_id, a.answer_id, coalesce(numeric_tokens, 0) AS numeric_tokens, coalesce(unsupported_numbers, 0) AS unsupported_numbers, coalesce(f < a.position, FALSE) AS evidence_references,
      NOT (coalesce(x < a.position, FALSE) AND ({causal})) AS causality_guardrail, coalesce(unsupported_numbers, 0) = 0 AS numeric_grounding, a.calculation_run_id = a.run_id AS run_linkage
      FROM a LEFT JOIN un ON un.run_id = a.run_id AND un.answer_id = a.answer_id LEFT JOIN b ON b.run_id = a.run_id)
    SELECT *, cast(round((evidence_references::INT + causality_guardrail::INT + numeric_grounding::INT + run_linkage::INT) / 4 * 100) AS INTEGER) AS score,
      evidence_references AND causality_guardrail AND numeric_grounding AND run_linkage AS passed FROM c"""


@query(
    "grounding_check",
    grounding_sql(
        "SELECT conv_id AS run_id, turn AS answer_id, turn AS position, text AS answer, conv_id AS calculation_run_id FROM conversations WHERE role = 'assistant'",
        "SELECT conv_id AS run_id, turn AS position, CASE WHEN role = 'system' THEN 'external-context' ELSE 'scope' END AS kind, text FROM conversations",
    ),
)
def grounding_check(spark, sf):
    c = table(spark, sf, "conversations")
    run, position = F.col("conv_id").alias("run_id"), F.col("turn").alias("position")
    answers = c.filter("role = 'assistant'").select(
        run, F.col("turn").alias("answer_id"), position, F.col("text").alias("answer"), F.col("conv_id").alias("calculation_run_id")
    )
    kind = F.when(F.col("role") == "system", "external-context").otherwise("scope").alias("kind")
    return G.grounding_check(answers, c.select(run, position, kind, "text"))


@query(
    "grounding_check_documents",
    grounding_sql(
        "SELECT source AS run_id, doc_id AS answer_id, doc_id AS position, text AS answer, CASE WHEN lang = 'en' THEN source ELSE lang END AS calculation_run_id FROM documents",
        "SELECT source AS run_id, doc_id AS position, CASE WHEN lang = 'en' THEN 'external-context' ELSE 'scope' END AS kind, text FROM documents",
    ),
)
def grounding_check_documents(spark, sf):
    d = table(spark, sf, "documents")
    run, position = F.col("source").alias("run_id"), F.col("doc_id").alias("position")
    english = F.col("lang") == "en"
    answers = d.select(
        run, F.col("doc_id").alias("answer_id"), position, F.col("text").alias("answer"),
        F.when(english, F.col("source")).otherwise(F.col("lang")).alias("calculation_run_id"),
    )
    kind = F.when(english, "external-context").otherwise("scope").alias("kind")
    return G.grounding_check(answers, d.select(run, position, kind, "text"))
