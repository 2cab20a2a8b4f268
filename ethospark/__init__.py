"""Movement and behaviour analytics on Spark."""
