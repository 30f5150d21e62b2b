"""Durable event logs and configuration files."""
