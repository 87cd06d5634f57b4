"""Scans: typed tables, vocabularies, rules and gazetteers."""
