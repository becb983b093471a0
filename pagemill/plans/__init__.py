"""Declarative specs, recipes and the pipelines compiled from them."""
