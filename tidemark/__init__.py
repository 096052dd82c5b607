"""Point-in-time, cross-sectional time-series analytics as PySpark DataFrame transformations."""
