"""gneiss: a Spark-native analytics engine for source-code indexes.

Every operator is a function from DataFrames to a DataFrame.  ``gneiss.llm`` (training-data
operators) is optional: nothing outside that subpackage imports it.
"""

__version__ = "0.1.0"
