"""Corpus preparation, hybrid retrieval, evidence checks and retrieval evaluation on Spark.

Every operator takes DataFrames and returns a DataFrame.  Nothing here opens a session or collects rows.
"""
