"""Stages of a measurement query, each a lazy DataFrame to DataFrame step."""
