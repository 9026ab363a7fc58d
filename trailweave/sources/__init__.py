"""Readers and writers of event logs, models, test suites and templates."""
