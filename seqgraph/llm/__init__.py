"""Operators for large text corpora: rules, duplicates, decontamination, mixing, scoring and token files."""
