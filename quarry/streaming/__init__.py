"""Documents and events that arrive as streams."""
