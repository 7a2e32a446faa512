"""Operators for preparing large text corpora.

Each module holds one operator; ``queries`` binds them to the tables.
Nothing outside this subpackage imports it.
"""
