"""Sources of folioforge."""
