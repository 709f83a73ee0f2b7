"""What can go wrong, as exceptions."""

from tidemark.functions.codec import Corruption


class StoreError(Exception):
    """Base of the errors a store raises."""


class NotFound(StoreError, KeyError):
    """A key, snapshot or file that is not there."""


class InvalidArgument(StoreError, ValueError):
    """An argument or option that makes no sense."""


class NotSupported(StoreError):
    """An operation this store does not offer."""


class StoreIOError(StoreError, OSError):
    """Storage failed."""


class Busy(StoreError):
    """Another writer is at work."""


class Closed(StoreError):
    """The store was closed, or stopped by an earlier error."""


__all__ = ["Busy", "Closed", "Corruption", "InvalidArgument", "NotFound", "NotSupported", "StoreError", "StoreIOError"]
