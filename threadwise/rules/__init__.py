"""Rule packs: the user-supplied data that drives intent, reply and routing rules."""
