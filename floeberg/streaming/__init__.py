"""Message queues as batch tables and as streams."""
