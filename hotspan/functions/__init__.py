"""functions of the thermal-anomaly engine."""
