"""Whole queries put together from sources and operators."""
