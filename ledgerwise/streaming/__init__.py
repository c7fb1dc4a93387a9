"""Formulas and guardrails over streams."""
