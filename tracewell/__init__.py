"""tracewell: evidence analytics over code and document corpora, as Spark plans."""
