"""lodestone: a PySpark-native engine for fact graphs, record linkage and link-prediction embeddings."""
