"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries and SQL are collected
in :mod:`tracework.llm.queries`.
"""
