"""Expressions and helpers shared by the operators."""
