"""Operators for large text corpora: identification, packing, redaction, de-duplication, archives and scoring."""
