"""Runnable jobs: ``python -m jobs.observations`` and ``python -m jobs.text_manifest``."""
