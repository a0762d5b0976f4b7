"""folioforge: a grounded text-to-assessment engine expressed as PySpark plans."""
