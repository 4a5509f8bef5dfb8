"""Upserts of micro-batches."""
