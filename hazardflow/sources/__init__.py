"""Feed, request and table readers, and the result sink."""
