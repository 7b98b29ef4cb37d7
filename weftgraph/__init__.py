"""Graph, interval and list analytics over namespaced identifiers, as Spark DataFrames."""
