"""Serving views and parameterised analytic queries."""
