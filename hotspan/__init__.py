"""Spark-first analytics over point detections of thermal anomalies."""
