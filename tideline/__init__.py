"""Market-stress analytics over panels of time series, as Spark DataFrame transformations."""
