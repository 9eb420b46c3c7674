"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; its queries are added to
``__spark_entry__`` only when it can be imported.
"""
