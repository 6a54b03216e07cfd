"""DataFrame to DataFrame, one function an operator."""
