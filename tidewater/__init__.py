"""tidewater: DataFrame-native profiling, cleaning, feature, text, time-series,
model and activity operators for PySpark."""

__version__ = "0.1.0"
