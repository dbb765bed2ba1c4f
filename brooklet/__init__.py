"""A live-query engine on Spark: registered single-table queries kept current by row-level feeds."""
