"""Evidence retrieval and corpus analytics expressed as Spark DataFrame plans."""
