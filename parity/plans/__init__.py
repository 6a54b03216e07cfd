"""Queries over the operators, the engine that runs them, and verdicts."""
