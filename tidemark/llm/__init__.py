"""Training-data operators: scanning, scoring, deduplicating and encoding whole corpora.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
