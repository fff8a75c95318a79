"""Retrieval, clustering and corpus analysis over DataFrames."""
