"""Reading and writing tables, columns and model weights."""
