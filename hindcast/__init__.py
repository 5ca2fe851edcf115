"""Point-in-time analytics over ledgers of transfers, as Spark DataFrame operators."""
