"""Coordination-record analytics on Spark: tasks, boards, specs, plans, decisions, chats, operations."""
