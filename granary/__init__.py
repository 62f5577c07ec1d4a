"""granary: DataFrame operators for messy records, written for Spark."""
