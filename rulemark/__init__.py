"""Rules-adjusted fund analytics on Spark."""
