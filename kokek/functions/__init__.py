"""Column functions and the fixed tables of suffixes and their forms."""
