"""streaming of tabwork."""
