"""End-to-end plans that chain several operators."""
