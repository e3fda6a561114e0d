"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator works on a DataFrame and the
names of the columns it needs, ignores other columns, and documents how it treats nulls,
empty and very long texts, ties and repeated rows.
"""
