"""A record reconciliation and training-data engine on PySpark."""
