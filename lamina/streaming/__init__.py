"""streaming of the document library."""
