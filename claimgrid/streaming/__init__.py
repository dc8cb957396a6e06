"""Streaming of claimgrid."""
