"""Declarative chart specifications as lazy DataFrame plans."""
