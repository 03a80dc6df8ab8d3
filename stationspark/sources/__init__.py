"""Readers, validation, the archive and exports."""
