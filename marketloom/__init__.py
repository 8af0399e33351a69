"""Market and personal-finance analytics on Spark."""
