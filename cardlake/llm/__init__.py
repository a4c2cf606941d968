"""Operators for training data made from decision logs. Nothing outside this subpackage imports it."""
