"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns a DataFrame; nothing outside this
subpackage imports it.
"""
