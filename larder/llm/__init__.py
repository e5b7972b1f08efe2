"""Training-data operators: token counts, decontamination, quality, language
models, near-duplicates, mixing, language ID, URL filters.

Nothing else in the library imports this subpackage.
"""
