"""Training-data operators: scoring, near-duplicates, decontamination, token output, packing.

Nothing outside this subpackage imports it; `queries.py` registers its queries.
"""
