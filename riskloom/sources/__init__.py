"""Tables in and out: shared intermediates, synthetic data, tree dumps, bundles."""
