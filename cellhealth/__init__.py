"""Network-health analytics on Spark: telemetry, cell windows, features, labels, monitoring."""
