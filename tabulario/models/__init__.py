"""Training, checking and applying models on Spark."""
