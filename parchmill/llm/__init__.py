"""Training-data operators: decontamination, dedup, quality, tokenization, sharding, archives.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; ``entry.py`` maps them to the registered queries.
"""
