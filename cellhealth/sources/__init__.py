"""Where telemetry comes from, and the stored tables."""
