"""Operators on tables of packets, units, slices, frames, blocks, pixels and samples."""
