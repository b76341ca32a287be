"""The model's expression languages, as Spark SQL expressions."""
