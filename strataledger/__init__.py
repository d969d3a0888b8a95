"""Loss-ledger analytics on Spark: report parsing, retrieval, pattern statistics."""
