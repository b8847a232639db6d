"""tidewatch: early-warning analytics over large collections of time series, as Spark DataFrame programs."""
