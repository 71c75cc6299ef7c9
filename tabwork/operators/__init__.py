"""operators of tabwork."""
