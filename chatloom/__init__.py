"""Conversation analytics on PySpark."""
