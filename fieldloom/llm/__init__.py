"""Training-data operators: text encoding, packing, dedup, filtering and search at corpus scale.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames (or
writes a table in the shared folder and returns a DataFrame over it).
"""
