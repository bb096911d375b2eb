"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  ``registry`` holds the
queries and SQL that ``__spark_entry__`` adds when this subpackage is present.
"""
