"""Registered queries, one module per family."""

from importlib import import_module

_MODULES = ["pixels", "rollup", "regions", "evidence", "texts", "gates", "scans", "stateful"]


def load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
