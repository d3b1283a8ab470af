"""tessera: retrieval, grounded-answer evaluation and corpus preparation as Spark DataFrame jobs."""
