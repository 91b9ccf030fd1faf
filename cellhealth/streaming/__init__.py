"""Continuous forms of the operators: windows, scoring, feature refresh, timed emission."""
