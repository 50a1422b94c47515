"""Training-data operators: near-duplicate joins, filters, tokenisation and output."""
