"""Column functions: arrays of pixels, header maps, paths, script values, star geometry."""
