"""Connected components, as the engine's operators have them."""

from strandline.operators.components import connected_components

__all__ = ["connected_components"]
