"""Column functions: text, dates, numbers, vectors and machine-readable zones."""
