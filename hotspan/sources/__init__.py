"""sources of the thermal-anomaly engine."""
