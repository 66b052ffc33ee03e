"""Spark-first toolkit for preparing and auditing language-model training corpora."""
