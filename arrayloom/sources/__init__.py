"""Readers, writers, generators and the fixtures of the registered queries."""
