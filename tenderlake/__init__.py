"""Public-procurement analytics expressed as Spark DataFrame plans."""
