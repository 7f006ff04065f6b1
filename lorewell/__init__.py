"""lorewell: document retrieval and document intelligence as Spark jobs."""
