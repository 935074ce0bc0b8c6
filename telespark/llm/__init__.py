"""Operators for preparing large text collections (see README, "Text pipeline").

Nothing outside this subpackage imports it; `catalog.py` here holds the registered
queries and their SQL.
"""
