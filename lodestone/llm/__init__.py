"""Training-data operators: one module each, every public function DataFrame -> DataFrame."""
