"""Relational operators, one module for each family.

Each module has ``QUERIES`` (name to a function of a session and a folder) and
``ORACLES`` (name to standard SQL with the same result).
"""
