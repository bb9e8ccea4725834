"""Operators of a training-data pipeline (PII, chat formatting, URL filters,
toxicity, line de-duplication, packing, decontamination, fingerprints, set
similarity joins, token counts). Nothing outside this subpackage imports it."""
