"""DataFrame operators; use them with ``df.transform`` or call them directly."""
