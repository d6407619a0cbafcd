"""Operators for preparing text corpora: canonical text, language labels, splitting, grouping,
name linking, packing, mixing and personal information. Nothing else in the library imports this."""
