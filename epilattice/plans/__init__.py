"""Whole screens, the derived inputs they are measured on, and the registered queries."""
