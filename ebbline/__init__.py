"""Subscription analytics as composable PySpark DataFrame operators."""
