"""Analytics over many conversation archives on Spark."""
