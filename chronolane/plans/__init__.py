"""Named queries on the driver tables."""
