"""Operators for preparing training text at scale: mixing, counting, archiving, packing, scoring, fingerprinting,
near-duplicate removal, personal data, quality rules and secrets. Nothing else in the library imports this package."""
