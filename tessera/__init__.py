"""tessera: multi-model analytics (key-value, sorted set, bitmap, stream, vector, graph, sketch) on plain Spark DataFrames."""
