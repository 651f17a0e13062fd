"""Operators for training text: language, form, turns, encoding, leaks and spam.

Nothing outside this package imports it.
"""
