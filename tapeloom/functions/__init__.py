"""Column functions that Spark lacks or that need guarding."""
