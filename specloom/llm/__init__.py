"""Training-data operators over document corpora.

Nothing else in the library imports this subpackage.  Each operator module has a
general interface; ``queries`` holds the thin registered queries.
"""
