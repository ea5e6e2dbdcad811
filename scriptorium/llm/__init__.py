"""Training-data operators: each module holds one operator, ``queries`` applies them to tables.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
