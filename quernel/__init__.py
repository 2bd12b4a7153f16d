"""A relational query engine on Spark: a small SQL dialect, an operator API, text sources and
sinks, table statistics and a cost-based join order, all assembled into DataFrames."""
