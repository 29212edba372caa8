"""Column functions: everything here is a narrow expression without a shuffle."""
