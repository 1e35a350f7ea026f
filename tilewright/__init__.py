"""Grid-contraction clustering and subspace clustering as Spark DataFrame plans."""
