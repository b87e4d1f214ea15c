"""Training-data operators: language, quality, tokens, decontamination, search, dedup, mixing, WARC.

Nothing outside this subpackage (and the optional registration in ``__spark_entry__``) imports it.
"""
