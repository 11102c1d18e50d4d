"""Column-level building blocks: path parts, glob matching, size text."""
