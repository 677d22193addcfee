"""operators of the seqgraph package."""
