"""Station-series and gridded-climate analytics expressed as Spark DataFrame operators."""
