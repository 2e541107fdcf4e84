"""Longitudinal-records analytics as plain DataFrame-to-DataFrame functions."""
