"""Situational play analytics as plain Spark DataFrame functions."""
