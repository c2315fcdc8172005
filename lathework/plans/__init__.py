"""Plan-level helpers: materialising, bounded sketches, components."""
