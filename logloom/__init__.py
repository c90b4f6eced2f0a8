"""Spark-native log sequence analytics: DataFrame and Column operators for event streams."""
