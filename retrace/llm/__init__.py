"""Operators of a training-data pipeline: filtering, deduplication, decontamination, scoring, mixing and output."""
