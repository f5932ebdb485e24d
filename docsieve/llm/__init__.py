"""Training-data operators: packing, deduplication, scans, sharding and archives."""
