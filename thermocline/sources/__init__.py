"""Sources and sinks: lake snapshots, hot partitions, JSON lines, change streams."""
