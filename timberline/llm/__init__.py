"""Operators for large-scale text-corpus preparation.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only where the subpackage is installed.
"""
