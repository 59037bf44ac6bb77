"""quern: a Spark-native engine that turns source code into tables, graphs and vectors and queries them."""

__version__ = "0.1.0"
