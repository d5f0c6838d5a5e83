"""Registered queries over the input tables, each with its SQL counterpart."""
