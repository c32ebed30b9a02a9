"""Usage-and-cost analytics for model-call logs, built from Spark DataFrame operators."""
