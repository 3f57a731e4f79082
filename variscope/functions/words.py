"""Fixed word lists, patterns and weights of the text rules."""

from __future__ import annotations

# Words that make an article positive or negative.
POSITIVE_WORDS = (
    "growth", "upgrade", "expansion", "partnership", "award", "approval", "beat", "strong",
    "launch", "record", "gain", "improve", "capacity", "recovery", "adds", "opportunity",
)
NEGATIVE_WORDS = (
    "outage", "lawsuit", "investigation", "fine", "decline", "miss", "layoff", "breach",
    "complaint", "strike", "recall", "shortage", "disruption", "downgrade", "weak",
    "fraud", "settlement", "constraint", "pressure", "slow", "slower", "risk",
)
# Topic tags and the words that give them.
TOPICS = {
    "operations": (
        "outage", "network", "service disruption", "availability", "fulfillment", "shipment",
        "shortage", "supply", "support", "replenishment",
    ),
    "competition/pricing": (
        "price", "pricing", "discount", "promotion", "bundle", "competitor", "market share",
        "switcher", "trade-in",
    ),
    "regulatory/legal": (
        "lawsuit", "investigation", "regulator", "fcc", "fine", "settlement", "court", "antitrust",
        "policy",
    ),
    "financial": ("earnings", "revenue", "profit", "subscriber", "guidance", "forecast", "quarter", "adds"),
    "labor/workforce": ("union", "strike", "layoff", "hiring", "workforce", "contract"),
    "product/technology": (
        "5g", "fiber", "broadband", "device", "wireless", "spectrum", "network upgrade", "capacity",
    ),
}
# Weight of a topic under each planning lens.
LENS_WEIGHTS = {
    "revenue": {"competition/pricing": 1.4, "product/technology": 1.15, "financial": 1.1, "operations": 0.85},
    "opex": {"operations": 1.35, "labor/workforce": 1.25, "regulatory/legal": 1.05, "financial": 0.9},
    "capex": {"product/technology": 1.35, "operations": 1.2, "financial": 1.0, "regulatory/legal": 0.95},
    "marketing": {"competition/pricing": 1.45, "product/technology": 1.05, "financial": 0.85, "operations": 0.7},
    "corporate": {"financial": 1.25, "regulatory/legal": 1.35, "labor/workforce": 1.05, "operations": 0.8},
    "workforce": {"labor/workforce": 1.5, "operations": 1.0, "financial": 0.8, "regulatory/legal": 0.75},
}
HINTED_WEIGHT, OTHER_WEIGHT = 0.8, 0.35
# Dimension names that hint at a topic.
TOPIC_HINTS = (
    ("operations", r"(inventory|fulfillment|service|support|store)"),
    ("competition/pricing", r"(offer|promo|price|channel|acquisition|campaign|source)"),
    ("product/technology", r"(product|device|fiber|wireless|plan|technology|network)"),
    ("labor/workforce", r"(employee|labor|workforce|headcount)"),
    ("regulatory/legal", r"(legal|regulatory|settlement|fine)"),
)
# Question intents, first match wins.
INTENTS = (
    ("quality", r"(quality|missing|duplicate|trust|reliable)"),
    ("external-hypothesis", r"(news|external|competitor|event|cause|why factor)"),
    ("time", r"(mtd|qtd|ytd|trend|time|month|quarter|year|pace|run rate|forecast bias|volatility)"),
    ("driver", r"(driver|contribut|dimension|factor|concentrat|drill|deeper)"),
    ("compare", r"(compare| versus | vs )"),
    ("navigation", r"(go back|reset|start over|show me|select)"),
    ("explain", r"(explain|summary|what happened|why are we)"),
)
# Tools of a question, the tools every question gets and those of a general one.
BASE_TOOLS = ("get_current_scope", "get_metric_definition")
TOOL_PATTERNS = (
    ("get_time_analysis", r"(mtd|qtd|ytd|trend|time|month|quarter|year|pace|run rate|forecast|volatility|bias)"),
    ("scan_dimensions", r"(driv|contribut|dimension|factor|concentrat|why|explain|what happened)"),
    ("find_interactions", r"(combined|interaction|together|combination|multi)"),
    ("get_data_quality", r"(quality|missing|duplicate|trust|reliable|coverage|valid)"),
    ("get_external_context", r"(news|external|competitor|event|cause|why factor|weather|outage|promotion)"),
)
GENERAL_TOOLS = ("get_time_analysis", "scan_dimensions")
# Evidence kinds a tool or an intent may use, and how many items each takes.
TOOL_KINDS = {
    "get_current_scope": ("scope", "dataset"),
    "get_metric_definition": ("metric-definition",),
    "get_time_analysis": ("time-series", "forecast-model", "variance"),
    "scan_dimensions": ("driver", "variance"),
    "find_interactions": ("interaction", "driver", "scope"),
    "get_data_quality": ("quality", "dataset", "limitation"),
    "get_external_context": ("external-context", "time-series", "driver", "limitation"),
}
INTENT_KINDS = {
    "explain": ("variance", "time-series", "forecast-model", "driver", "quality", "metric-definition"),
    "time": ("time-series", "forecast-model", "variance", "metric-definition", "quality"),
    "driver": ("driver", "interaction", "variance", "scope", "metric-definition"),
    "quality": ("quality", "dataset", "metric-definition"),
    "external-hypothesis": ("external-context", "driver", "time-series", "variance", "limitation"),
    "navigation": ("scope", "driver"),
    "compare": ("driver", "variance", "scope"),
    "unknown": ("variance", "driver", "time-series"),
}
TOOL_ITEMS, WIDE_TOOL_ITEMS = 5, 8
# Causal wording, numeric tokens and their runs in evidence text.
CAUSAL_PATTERNS = (
    r"\bcaused\b", r"\bproved? that\b", r"\bdue to\b", r"\bresulted in\b", r"\bdefinitely explains\b",
)
NUMBER_TOKEN = r"(?i)[-+]?\$?\d[\d,.]*(?:%|[KMBT])?"
NUMBER_RUN = r"[-+]?[\d.]+[%kmbt]?"
