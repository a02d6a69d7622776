"""Part of sievelight."""
