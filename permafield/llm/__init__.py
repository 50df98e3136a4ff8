"""Operators for large text corpora: cleaning, de-duplication, tokenising, packing and storing.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
