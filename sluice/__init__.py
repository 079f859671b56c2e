"""Message ETL on Spark: dynamic JSON envelopes, routing, scripted transforms, sinks and statistics."""

__version__ = "0.1.0"
