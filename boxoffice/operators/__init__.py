"""Operators: each takes tables of rows and tables of requests and returns tables."""
