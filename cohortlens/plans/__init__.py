"""Feature jobs, model jobs and group-difference measures built from the operators."""
