"""Register-gazette analytics as composable Spark DataFrame operators."""
