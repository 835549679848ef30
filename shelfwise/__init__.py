"""Content-based item recommendation analytics on PySpark.

Every operator takes DataFrames and parameters and returns a DataFrame; Spark
plans, partitions and shuffles the work.
"""
