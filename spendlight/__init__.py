"""Evidence analytics over public-spending data, expressed as Spark DataFrame transforms."""
