"""Screening of prompts and analysis of the log that comes out of it."""
