"""All registered queries. Importing this package registers them."""

from importlib import import_module

from .registry import ORACLES, QUERIES  # noqa: F401

for _name in ("text", "numbers", "sequences", "signals", "timelines", "catalog", "folds", "files"):
    import_module(f"{__name__}.{_name}")
