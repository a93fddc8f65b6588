"""Connected components; the core's own."""

from tidemark.operators.graph import connected_components

__all__ = ["connected_components"]
