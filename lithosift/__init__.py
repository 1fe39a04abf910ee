"""A Spark-native engine for collections of features, and for corpora."""
