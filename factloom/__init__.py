"""factloom: set-shaped code-intelligence queries and training-data operators on Spark."""
