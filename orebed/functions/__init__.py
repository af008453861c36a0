"""Part of orebed; see the README for the map of modules."""
