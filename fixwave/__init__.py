"""Radio-telemetry and movement analytics on Spark."""
