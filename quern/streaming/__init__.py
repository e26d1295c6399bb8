"""Incremental evaluation: transactions of signed changes, and streams that feed them."""
