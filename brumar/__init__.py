"""brumar: sensor, text and training-data processing on PySpark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here owns
a SparkSession; nothing at import time touches Spark.
"""
