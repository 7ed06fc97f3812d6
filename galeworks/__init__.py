"""Severe-wind analytics as DataFrame operators."""
