"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

``registry.QUERIES`` and ``registry.ORACLE`` list the queries and their SQL.
"""
