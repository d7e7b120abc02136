"""Stateful controls as Structured Streaming jobs and their batch forms."""
