"""Whole analyses put together from operators, and the queries registered over the test tables."""
