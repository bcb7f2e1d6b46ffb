"""Operators for preparing training text, each by a stated method.

Every module holds one operator; ``queries`` registers them. Nothing else in
the library imports this package.
"""
