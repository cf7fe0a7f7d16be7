"""Sources: trees of files and tables."""
