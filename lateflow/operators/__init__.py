"""Fact builds, root-cause questions, Pareto, diagnostics and quality checks."""
