"""lodestone: code-structure, telemetry and text analytics as Spark DataFrame plans."""
