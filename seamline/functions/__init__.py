"""Part of seamline."""

