"""Readers and writers of the jobs' tables."""
