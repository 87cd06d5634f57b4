"""Exports."""
