"""Operators of a training-data pipeline.

Nothing else in the library imports this package; its queries are in
``queries`` and the staged pipeline in ``corpus_pipeline.py`` at the top.
"""
