"""Extensions on Structured Streaming."""
