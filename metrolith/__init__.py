"""metrolith: measurement analytics expressed as Spark DataFrame plans."""
