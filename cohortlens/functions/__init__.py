"""Column functions: label cleaning, text normalising, document building."""
