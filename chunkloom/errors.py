"""Error classes; each stands for one kind of misuse of an array."""


class ChunkloomError(Exception):
    """Base of all errors raised here."""


class InvalidParam(ChunkloomError, ValueError):
    """A shape, axis, dtype or option that makes no sense."""


class InvalidIndex(ChunkloomError, IndexError):
    """A coordinate or chunk number outside the array."""


class ChunkError(ChunkloomError):
    """An operation the array's chunking does not allow."""


class MetalayerNotFound(ChunkloomError, KeyError):
    """No metadata layer has this name."""


class StoreExists(ChunkloomError, FileExistsError):
    """A store is already at this path."""


class StaleSchema(ChunkloomError):
    """More than the shape changed between two versions of a store."""
