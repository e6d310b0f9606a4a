"""Consumer-lending analytics expressed as Spark DataFrame plans."""
