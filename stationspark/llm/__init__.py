"""Operators for preparing large language-model training data, each a distributed Spark job."""
