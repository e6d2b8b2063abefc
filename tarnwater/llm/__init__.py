"""Training-data operators.

A self-contained subpackage: nothing else in the library imports it.  Each
module holds one operator with its own general interface and, at its end, the
thin ``opN_*`` query that applies it to a whole table.
"""
