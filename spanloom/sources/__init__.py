"""Adapters that show the driver tables as telemetry and registry tables."""
