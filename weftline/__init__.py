"""Tables to searchable text and vectors and back, as Spark jobs."""
