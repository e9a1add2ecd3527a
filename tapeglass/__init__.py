"""Analytics over market-data-style event panels, written as Spark DataFrame plans."""

__version__ = "0.1.0"
