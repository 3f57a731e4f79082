"""The registered queries and their DuckDB counterparts, one module per subject."""

from importlib import import_module

from variscope.catalog.registry import ENTRIES, Entry

MODULES = [
    "cohorts",
    "attribution",
    "drivers",
    "timeseries",
    "payments",
    "quality",
    "forecasting",
    "semantics",
    "hierarchies",
    "texts",
    "claims",
    "storage",
]


def load() -> dict[str, Entry]:
    """All registered entries by name."""
    for m in MODULES:
        import_module(f"variscope.catalog.{m}")
    return ENTRIES
