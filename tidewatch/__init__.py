"""Rule-based anomaly detection and change-stream warehousing on Spark."""
