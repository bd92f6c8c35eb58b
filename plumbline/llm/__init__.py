"""Operators for preparing training text at scale: thirteen of them, each usable on its own.

Nothing else in the library imports this subpackage.
"""
