"""Connected components of a link table, without collecting it: the engine's own operator serves here too."""

from casegraph.operators.graph import components

__all__ = ["components"]
