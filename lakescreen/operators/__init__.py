"""DataFrame to DataFrame operators of the screening analytics."""
