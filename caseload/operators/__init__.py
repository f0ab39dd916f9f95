"""Operators of the review-analytics engine."""
