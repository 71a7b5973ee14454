"""Training-data operators: every operator is a module, `queries` registers one query for each."""
