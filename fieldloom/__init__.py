"""Grid queries, scoring and evaluation of two-dimensional fields as Spark jobs."""
