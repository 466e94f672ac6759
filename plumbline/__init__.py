"""Spark-native analytics on price panels: volatility, correlation, positions, signals and P&L."""
