"""A code-graph and data-processing engine written as Spark plans."""

from .annotations import blocking, non_blocking, unblocker

__all__ = ["blocking", "non_blocking", "unblocker"]
