"""quillspark: an analytics engine expressed on PySpark DataFrames and Spark SQL."""

__version__ = "0.1.0"
