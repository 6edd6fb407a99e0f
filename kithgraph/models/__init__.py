"""Models: matrix factorisation with side features and ties, classifiers, and a registry."""
