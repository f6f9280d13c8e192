"""Operators on tables of page elements and of Markdown texts: DataFrame in, DataFrame out."""
