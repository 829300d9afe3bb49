"""Stages over unbounded samples."""
