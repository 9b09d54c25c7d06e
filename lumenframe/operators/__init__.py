"""DataFrame-to-DataFrame operators over movies, pixels, footprints and traces."""
