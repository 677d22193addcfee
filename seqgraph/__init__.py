"""DataFrame operators for ordered token sequences, graphs and training-data corpora."""
