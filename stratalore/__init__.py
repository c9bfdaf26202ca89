"""stratalore: a PySpark-native retrieval and analytics engine for knowledge collections."""
