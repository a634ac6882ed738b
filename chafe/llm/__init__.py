"""Operators of a training-data pipeline over web-scale document tables.

One module per operator; ``queries`` registers one query for each of them.
Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.
"""
