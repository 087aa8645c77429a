"""Operators for training data: groups, overlaps, splits, token ids, packing and sentences."""
