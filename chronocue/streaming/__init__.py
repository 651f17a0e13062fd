"""The same results, incrementally."""
