"""Endpoint-telemetry detection and investigation on Spark DataFrames."""
