"""Read-only analytics over versioned, keyed table snapshots, on Spark."""
