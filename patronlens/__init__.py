"""Customer analytics on Spark: profiles, features, models, scoring and reports."""

__version__ = "0.1.0"
