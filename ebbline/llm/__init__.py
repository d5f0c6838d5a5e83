"""Operators for preparing training text, one module each.

Nothing outside this folder imports it. `queries` registers one query per operator.
"""
