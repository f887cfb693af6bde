"""radonframe: tomographic data processing expressed as Spark DataFrame jobs."""
