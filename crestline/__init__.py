"""A PySpark-native engine that ranks what is popular right now in an event stream."""
