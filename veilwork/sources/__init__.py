"""Tables: files, and the generated ones that tests and examples use."""
