"""Operators for training data: consensus, entry matching, record linkage, pair counts, language, encoding, mixing, splitting."""
