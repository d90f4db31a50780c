"""quernstone: a PySpark-native engine for short search-query text and its entity tags."""
