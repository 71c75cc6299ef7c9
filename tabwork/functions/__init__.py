"""functions of tabwork."""
