"""Operators of a training-data pipeline over whole text corpora.

Each module holds one operator; ``registry`` binds them to the test tables as
``opN_<name>`` queries. Nothing outside this package imports it.
"""
