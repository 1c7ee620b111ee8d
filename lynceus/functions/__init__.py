"""Column functions that need no DataFrame."""
