"""sagewell: memory, retrieval and vector analytics expressed as Spark DataFrame plans."""
