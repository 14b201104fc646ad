"""foldcast: rolling-origin panel forecasting on Spark."""
