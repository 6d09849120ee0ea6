"""Event-graph analytics on Spark: build, sample and evaluate graphs of events with DataFrames."""
