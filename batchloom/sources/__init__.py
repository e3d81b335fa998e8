"""Table storage: specification, manifest, scans, sinks and synthetic feeds."""
