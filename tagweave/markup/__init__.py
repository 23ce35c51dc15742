"""The parser and everything that works on one document in memory."""
