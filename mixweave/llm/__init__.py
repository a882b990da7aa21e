"""Operators for preparing training text at scale; nothing else in mixweave imports this package."""
