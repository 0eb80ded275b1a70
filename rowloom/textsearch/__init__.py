"""Text chunks and nearest vectors."""
