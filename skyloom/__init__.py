"""skyloom: a PySpark-native engine for catalog analytics and corpus preparation."""
