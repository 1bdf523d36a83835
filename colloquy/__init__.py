"""Conversation analytics on Spark: transcripts in, typed tables and answers out."""
