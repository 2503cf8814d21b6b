"""Distributed connected components, as the rest of the library has them."""

from factloom.operators.components import connected_components

__all__ = ["connected_components"]
