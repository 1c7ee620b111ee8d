"""Whole evaluations, composed of the operators."""
