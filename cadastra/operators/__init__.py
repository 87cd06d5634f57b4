"""Transforms of interval-dated facts and of the hierarchy they lie in."""
