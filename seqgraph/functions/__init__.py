"""functions of the seqgraph package."""
