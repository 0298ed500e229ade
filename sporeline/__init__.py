"""Genomics table jobs and training-data jobs as Spark DataFrame functions."""
