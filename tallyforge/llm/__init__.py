"""Operators for preparing large text corpora.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries`` applies them to the standard tables.
"""
