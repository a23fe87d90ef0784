"""Column functions: normalisation, similarity, keys, predicates and rule-based classifiers."""
