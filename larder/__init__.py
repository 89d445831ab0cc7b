"""Larder: DataFrame operators for recipe-style catalogues on Spark."""
