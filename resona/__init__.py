"""resona: audience-comment analytics written as Spark DataFrame jobs."""
