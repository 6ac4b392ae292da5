"""Scans and sinks: image files, logs, session reports, and the adapters that read tables as frames."""
