"""Spark DataFrame operators for regional time series and the flows between regions."""
