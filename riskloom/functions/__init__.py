"""Scalar building blocks: rounding, ratios, class labels, column checks, p-values."""
