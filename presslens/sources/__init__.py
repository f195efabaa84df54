"""Scans: landed feeds, sitemaps, feed probes, pages and stored articles."""
