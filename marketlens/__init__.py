"""marketlens: web competitive intelligence as Spark jobs.

Every public operator is a function from DataFrames to DataFrames; nothing is
collected, and nothing runs until the caller writes or shows the result.
"""
