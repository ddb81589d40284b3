"""The registered queries; both modules add theirs to ``catalogue.QUERIES``."""

from . import catalogue, picture_files

__all__ = ["catalogue", "picture_files"]
