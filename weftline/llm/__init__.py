"""Operators for training data; nothing else in the engine imports this subpackage."""
