"""Search, ranking and rendering of analyses."""
