"""Operators for preparing language-model training text, and their queries.

Nothing else in the library imports this subpackage; it may import general
helpers from the rest of the library.
"""
