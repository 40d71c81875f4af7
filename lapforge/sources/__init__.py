"""Readers and writers of the telemetry lake."""
