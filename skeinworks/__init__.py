"""Skeinworks: Spark-native construction, labelling and reporting of conversation corpora."""
