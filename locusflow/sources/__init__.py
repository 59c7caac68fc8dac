"""Readers. Each text format has a ``parse_*`` step on a frame of lines, so the same
code serves files and lines produced by another job."""
