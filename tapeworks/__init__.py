"""Market-signal, fill-accounting and execution-quality analytics on Spark."""
