"""News-sentiment analytics as Spark DataFrame transformations.

``functions``  column expressions (URLs, text, labels, dates, exact rounding)
``sources``    feeds, sitemaps, feed probes and the scored-article scan
``operators``  dedupe, discovery, extraction, scoring, store, views, reports
``plans``      whole runs put together from the operators
``streaming``  incremental ingest and scoring on Structured Streaming
"""
