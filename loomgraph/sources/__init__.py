"""Table scans, sinks and connectors."""
