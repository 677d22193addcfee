"""streaming of the seqgraph package."""
