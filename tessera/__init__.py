"""Spark-first analytics over losslessly compressed numeric series, plus training-data operators in ``tessera.llm``."""
