"""A PySpark-native engine for receipt and invoice text, and for training-data tables."""
