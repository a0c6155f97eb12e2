"""Spark-native extraction, association and quality operators for scientific plates.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver unless its size bound is a documented parameter.
"""
