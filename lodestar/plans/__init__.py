"""Registered queries, built from the operators, with their oracles."""
