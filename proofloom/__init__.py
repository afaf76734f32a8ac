"""A PySpark-native engine that scores, audits and prepares the evidence behind extracted statements."""
