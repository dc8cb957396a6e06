"""Plans of claimgrid."""
