"""Operators of a training-data pipeline over text, pages, chats and vectors.

Each module holds one operator with its own interface; ``queries.py`` binds
them to the driver tables.  Nothing outside this folder (and
``corpus_pipeline.py``) imports it.
"""
