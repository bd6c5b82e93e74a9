"""Catalogue, label-text and reconciliation analytics expressed as Spark plans."""
