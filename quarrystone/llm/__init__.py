"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and
returns a DataFrame; ``entry`` registers one query per operator.
"""
