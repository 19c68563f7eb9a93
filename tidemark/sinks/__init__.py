"""Records to files, to the console, or to a collector."""
