"""Column functions: text, addresses, dates, rates, intervals."""
