"""Iteration, dispatch, reports and the registered queries."""
