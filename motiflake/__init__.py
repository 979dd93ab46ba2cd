"""Tandem-repeat analytics as DataFrame operators."""
