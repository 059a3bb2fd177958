"""Column expressions: tokens, text cleaning, predicates, scores."""
