"""Whole reports, composed from the operators as single lazy plans."""
