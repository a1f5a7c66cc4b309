"""driftlens: boundary-drift analytics expressed as Spark DataFrame plans."""
