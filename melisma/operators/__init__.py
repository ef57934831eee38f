"""operators of the catalogue analytics library."""
