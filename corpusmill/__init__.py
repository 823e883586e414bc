"""corpusmill: training-corpus building as Spark jobs."""
