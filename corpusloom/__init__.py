"""Spark-first data preparation, evaluation and grading for language-model corpora."""
