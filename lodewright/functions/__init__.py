"""Column functions: native text functions, and Arrow functions where no native form exists."""
