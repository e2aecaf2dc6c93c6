"""Operators for large text corpora: cleaning, deduplication, scoring and mixing of training data.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames; bounded intermediate
tables go to the shared folder named by ``spark.checkpoint.dir``.
"""
