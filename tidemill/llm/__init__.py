"""Operators for preparing training text: packing, language, decontamination, quality,
deduplication, archives, licences, media and page extraction.

Nothing outside this subpackage imports it.
"""
