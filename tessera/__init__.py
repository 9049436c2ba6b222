"""A PySpark-native analytics engine: semantic models, a calculation language and requests compiled to DataFrame plans."""
