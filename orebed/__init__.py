"""orebed: analytics, data mining and corpus preparation as Spark DataFrame plans."""
