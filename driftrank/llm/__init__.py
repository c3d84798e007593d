"""Operators that prepare training text: one module each, plus their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
