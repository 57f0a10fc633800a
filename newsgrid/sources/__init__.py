"""Landed inputs and stored outputs."""
