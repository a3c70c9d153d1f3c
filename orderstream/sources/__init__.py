"""Where the data comes from: tables, event streams, logs, report files and stored snapshots."""
