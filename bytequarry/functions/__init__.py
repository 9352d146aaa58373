"""Part of bytequarry."""
