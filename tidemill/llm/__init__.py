"""llm of tidemill."""
