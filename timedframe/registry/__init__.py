from importlib import import_module

from timedframe.registry.core import ORACLES, QUERIES

MODULES = ["segments", "lookups", "jobs", "catalog", "formats", "intervals", "scalars", "pages", "corpus", "sources", "streams", "plans", "extensions"]


def _load():
    for m in MODULES:
        import_module(f"timedframe.registry.{m}")


def all_queries():
    _load()
    return QUERIES


def all_oracles():
    _load()
    return ORACLES
