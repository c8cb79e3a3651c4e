"""operators of the document library."""
