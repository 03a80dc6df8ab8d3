"""Scalar expressions over observation columns; built-in column functions only."""
