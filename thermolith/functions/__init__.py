"""Column functions: predicates, text formats and parsers."""
