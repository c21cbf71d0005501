"""folioflow: document conversion and analytics expressed as Spark plans."""
