"""Folders that are followed as files arrive."""
