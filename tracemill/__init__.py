"""tracemill: Spark-first analytics over agent traces and the data sets made from them."""

__version__ = "0.1.0"
