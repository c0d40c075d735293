"""Operators for training data: matching, linking, tokenising and cleaning at corpus scale."""
