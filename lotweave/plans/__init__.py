"""Candidate plan generation, objectives and selection."""
