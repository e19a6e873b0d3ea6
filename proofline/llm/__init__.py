"""Training-data operators: ten text and vector operators plus their queries.

Nothing outside this subpackage imports it.
"""
