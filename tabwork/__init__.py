"""tabwork: everyday table work on many files at once, as plain DataFrame functions on Spark SQL."""
