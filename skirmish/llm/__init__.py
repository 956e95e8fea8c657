"""Operators for preparing training text: ten components over documents, conversations and codes.

Nothing else in the package imports this subpackage.
"""
