"""Column helpers: exact decimal arithmetic, counting, banding, labels."""
