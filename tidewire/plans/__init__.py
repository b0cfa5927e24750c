"""Declarative graphs and their compilation to DataFrame plans."""
