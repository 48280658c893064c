"""A PySpark engine that finds, explains, suppresses and redacts identifiers in text at scale."""
