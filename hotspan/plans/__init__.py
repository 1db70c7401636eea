"""plans of the thermal-anomaly engine."""
