"""Operators of claimgrid."""
