"""claimgrid: claim extraction and contradiction analytics as Spark jobs."""

__version__ = "0.1.0"
