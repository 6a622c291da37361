"""All registered queries; importing this package fills the catalog."""

from importlib import import_module

from .registry import CATALOG

MODULES = ["text", "ranking", "context", "structure", "checks", "review", "sections", "projects", "images", "topics", "store"]

for _name in MODULES:
    import_module(f"{__name__}.{_name}_queries")

__all__ = ["CATALOG"]
