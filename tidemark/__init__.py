"""Spark-first analytics over logged rollouts: replay, statistics, and corpus-scale data operators."""
