"""Named queries and the analysis pipeline."""
