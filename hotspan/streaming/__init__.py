"""streaming of the thermal-anomaly engine."""
