"""Where frames come from: event streams, contract tables, the feature store, given tables."""
