"""Readers and writers of run logs, reports and fitted results."""
