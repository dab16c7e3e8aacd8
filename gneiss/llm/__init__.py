"""Training-data operators.  Optional: the rest of the library never imports this package."""
