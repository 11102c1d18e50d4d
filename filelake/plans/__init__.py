"""Plan tables: applying, verifying, logging and batching them, and the
chained reorganisation."""
