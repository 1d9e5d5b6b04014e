"""Connected components, as in the shared module."""

from ..components import components

__all__ = ["components"]
