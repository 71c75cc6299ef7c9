"""sources of tabwork."""
