"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Each ``<name>.py`` module holds one operator with a general interface.
``queries.py`` registers the thin ``opN_<name>`` queries over the synthetic
tables and ``oracles.py`` their SQL where SQL can express them.
"""
