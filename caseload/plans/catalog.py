"""Importing this module registers every query of the package."""

from caseload.plans import drawn, pieces, quality, relations, reports, scope, study, texts  # noqa: F401
