"""Operators for preparing training text: rules, joins, dedup, packing, scoring, scans.

Nothing else in the library imports this package. Each module has one operator with a
general interface; `queries` registers one query per operator.
"""
