"""tessera: retrieval analytics over document collections, as plain Spark jobs."""
