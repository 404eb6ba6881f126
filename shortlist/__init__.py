"""Ranked, de-duplicated shortlists from large collections of postings, on Spark."""
