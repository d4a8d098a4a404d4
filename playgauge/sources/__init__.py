"""Table declarations, loading and writing."""
