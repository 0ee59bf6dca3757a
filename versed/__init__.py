"""Document analytics on Spark: versioned corpora, lexical and vector search, quote checks, gates and metrics."""
