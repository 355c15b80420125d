"""The text, structure and patch functions keep no state, so they run on streaming tables as they are."""
