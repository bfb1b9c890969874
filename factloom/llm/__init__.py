"""Training-data operators: scoring, archives, token counts, filters, dedup and mixing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, selects the
columns it needs by name and ignores all others, so extra columns never clash.
"""
