"""Operators of a large-scale training-data pipeline (token counts, extraction, quality,
language, de-duplication, licences, decontamination, token files, similarity join, packing).

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
