"""Relational operators (DataFrame -> DataFrame) of the postings analytics."""
