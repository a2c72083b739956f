"""Analytics for labelled aligned sequences, sparse taxon-by-locus grids and annotated records."""
