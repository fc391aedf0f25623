"""Column-to-column helpers: cleaning, parsing, names, places, labels."""
