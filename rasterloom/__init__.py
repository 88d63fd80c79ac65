"""rasterloom: raster analytics expressed as Spark DataFrame plans."""
