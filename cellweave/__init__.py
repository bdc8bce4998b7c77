"""cellweave: single-cell read analytics and data preparation as Spark DataFrame plans."""
