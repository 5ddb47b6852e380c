"""memlake: evidence-backed event memory as Spark DataFrames."""
