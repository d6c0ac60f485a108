"""Operators for preparing training data of language models. Nothing outside this folder imports it, except by way of
__spark_entry__.py and corpus_pipeline.py."""
