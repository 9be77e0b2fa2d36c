"""Message readers, table scans and period-partitioned tables."""
