"""Training-data operators. Nothing outside this package (but the entry point's guard) imports it."""
