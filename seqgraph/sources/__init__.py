"""sources of the seqgraph package."""
