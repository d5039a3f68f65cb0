"""relaylens: Spark-native analytics over Postfix mail-delivery logs."""

__version__ = "0.1.0"
