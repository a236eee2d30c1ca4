"""Column functions: built-in expressions where Spark has them, Arrow UDFs where it has not."""
