"""Analytic operators over event logs."""
