"""rillstone: a PySpark-native engine for the data plane of language-model post-training."""
