"""Operators that prepare text collections for training; nothing outside this subpackage imports it."""
