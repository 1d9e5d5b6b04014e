"""Posting analytics on Spark: DataFrame operators for semi-structured postings."""
