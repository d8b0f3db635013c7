"""Compositions of operators into reports and manifests."""
