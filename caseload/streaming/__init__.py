"""Streaming of the review-analytics engine."""
