"""Interval-dated facts on a time-varying hierarchy, as Spark DataFrame transforms."""
