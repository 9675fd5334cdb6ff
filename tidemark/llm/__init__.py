"""Operators for preparing training text: thirteen components, each in a module of its own.

Nothing else in the library imports this subpackage, and it imports nothing else from the library.
"""
