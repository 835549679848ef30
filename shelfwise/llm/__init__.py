"""Operators for preparing training data: deduplication, mixing, quality, language, tokens, HTML, personal data.

Nothing outside this folder imports it. Every operator is a function from DataFrames to a DataFrame;
``queries.py`` registers one thin query per operator.
"""
