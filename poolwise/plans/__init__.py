"""The query catalog."""

from importlib import import_module

from .registry import QUERIES, Query

PLAN_MODULES = ("workload", "policies", "forecasting", "decisions", "imports", "ledgers", "chains")


def load_all() -> dict[str, Query]:
    for name in PLAN_MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES
