"""Indexes that change while they are searched."""
