"""Readers and writers of manifests, predictions and image files."""
