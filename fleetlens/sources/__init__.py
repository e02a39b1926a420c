"""Reading, writing and maintaining stored layers."""
