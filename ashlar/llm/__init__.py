"""Training-data operators: near-dedup, scans, scoring, filtering and mixing.

Nothing outside this subpackage imports it; the entry module adds its queries
only when it can be imported.
"""
