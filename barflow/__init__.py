"""Time-series analytics on Spark: bars, features, as-of joins, labels, validation, backtests."""
