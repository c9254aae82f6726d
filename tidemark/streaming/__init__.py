"""Time windows over tables and over streams."""
