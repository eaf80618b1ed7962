"""Privacy-risk scans and training-data operators on Spark."""

from riskweave.functions.catalog import read_catalog, write_catalog
from riskweave.plans.scan import Scan, read_artifact, redacted, register_of, scan_directory, scan_tree, write_artifact
from riskweave.sources.tree import read_tree, resolve

__all__ = ["Scan", "read_artifact", "read_catalog", "read_tree", "redacted", "register_of", "resolve", "scan_directory", "scan_tree", "write_artifact", "write_catalog"]
