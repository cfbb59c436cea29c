"""Corpus preparation for language-model training.

Nothing outside this subpackage imports it; the folder can be removed and the
process-analytics part of the library keeps working.
"""
