"""Sources of claimgrid."""
