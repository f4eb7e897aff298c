"""Column functions: text, binding, rendering, wire values and the filter language."""
