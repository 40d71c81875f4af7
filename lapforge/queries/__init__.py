"""Registered queries over the given tables, each with its check SQL where SQL can express it."""

from importlib import import_module

MODULES = ("cleaning", "sessions", "video", "lake", "circuit", "forests")


def load_all():
    """Import every query module; returns the filled registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
