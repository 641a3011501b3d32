"""Whole jobs built from the operators, and the registered queries."""
