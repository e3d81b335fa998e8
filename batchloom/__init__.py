"""batchloom: append-only tick tables, zone-map pruned scans and data-quality operators on PySpark."""

__version__ = "0.1.0"
