"""Column functions: ordering, sequences, vectors, binning."""
