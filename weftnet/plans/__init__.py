"""Logical plans: derived networks, declarative models, staging."""
