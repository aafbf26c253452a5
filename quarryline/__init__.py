"""quarryline: repository-intelligence analytics as PySpark DataFrame programs."""
