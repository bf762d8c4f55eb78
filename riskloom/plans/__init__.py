"""Complete analyses composed from the operators."""
