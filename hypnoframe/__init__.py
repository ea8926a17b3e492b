"""A PySpark-native engine for annotated multichannel time series."""
