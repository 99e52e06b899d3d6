"""Operators for preparing training text: duplicates, labels, search, packing, archives, mixing, sharding."""
