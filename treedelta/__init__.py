"""treedelta: structural diffs of two snapshots of a corpus, as Spark DataFrames."""
