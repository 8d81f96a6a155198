"""furrow: field-boundary analytics expressed as Spark DataFrame jobs."""
