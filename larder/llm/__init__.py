"""Operators for preparing training text, each a function of DataFrames.

Nothing outside this folder imports it; ``queries`` registers one query per operator.
"""
