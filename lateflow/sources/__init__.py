"""Raw-layer schemas, CSV ingest and the test-table mapping."""
