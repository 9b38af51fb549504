"""Named queries: (SparkSession, table dir) -> DataFrame, and their SQL
oracles for an independent engine."""
