"""The registered queries, by subject."""

from importlib import import_module

MODULES = ("text_queries", "fact_queries", "model_queries", "collation_queries", "detail_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
