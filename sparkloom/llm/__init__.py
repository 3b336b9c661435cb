"""Training-data operators: the ten dealt operators and their queries."""
