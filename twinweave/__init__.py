"""twinweave: record linkage, de-duplication and corpus preparation as Spark DataFrame operators."""
