"""operators of the thermal-anomaly engine."""
