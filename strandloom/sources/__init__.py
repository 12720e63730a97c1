"""Readers and writers of sequence formats, taxonomies and configuration."""
