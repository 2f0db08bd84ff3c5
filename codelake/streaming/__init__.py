"""Live job and request streams."""
