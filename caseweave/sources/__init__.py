"""Readers and writers of event logs and object-centric logs."""
