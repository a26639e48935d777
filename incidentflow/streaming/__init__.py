"""Structured Streaming jobs: ledger ingest, running statistics, retrain on arrival."""
