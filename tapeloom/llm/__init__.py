"""Operators for preparing training text: one module for each operator.

Nothing outside this package imports it; ``queries`` registers its queries.
"""
