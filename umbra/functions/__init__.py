"""Column functions and statistics on grouped frames."""
