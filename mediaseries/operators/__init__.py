"""DataFrame operators: merge, classify, roll up, align, correlate, summarise."""
