"""Operators for training data made of crawled text; nothing else in the library imports this package."""
