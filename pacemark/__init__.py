"""pacemark: how long work items take, computed on Spark.

Every operator is a function from DataFrames to a DataFrame, keyed by
``(repo, issue_number)``; nothing is aligned by row position.
"""
