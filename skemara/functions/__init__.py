"""Part of Skemara."""
