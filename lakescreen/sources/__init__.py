"""Readers, table schemas, and the screening views over the driver tables."""
