"""Domain-name monitoring and corpus operators on Spark."""
