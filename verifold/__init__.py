"""Document validation, matching and batch evaluation as Spark DataFrame operators."""
