"""Operators that a training-data pipeline adds to the library.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries.
"""
