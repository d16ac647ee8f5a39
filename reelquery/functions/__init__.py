"""Part of reelquery."""
