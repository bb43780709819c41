"""Column functions and small numeric helpers."""
