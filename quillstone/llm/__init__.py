"""Training-data operators: filtering, joining, redacting, mixing and packing of text corpora."""
