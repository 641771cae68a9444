"""Lineage-aware drift detection and deploy gating on Spark DataFrames."""
