"""Tarn: recall over knowledge stores, written as Spark DataFrame programs."""
