"""Scans, sinks, path catalogs and manifests."""
