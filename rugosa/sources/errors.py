"""What can go wrong with files and surfaces."""


class SurfaceError(Exception):
    """Base of all errors of this package."""


class CannotDetectFileFormat(SurfaceError):
    """No reader takes the file."""


class CorruptFile(SurfaceError):
    """A file of a known format whose content contradicts itself."""


class MetadataAlreadyFixedByFile(SurfaceError):
    """The caller gave what the file itself says."""


class UnknownChannel(SurfaceError):
    """No channel of that index or id."""


class UndefinedData(SurfaceError):
    """An analysis that needs every pixel met undefined ones."""


class ReentrantData(SurfaceError):
    """An analysis that needs a single-valued profile met overhangs."""


class NoReliableData(SurfaceError):
    """Nothing is left after unreliable scales are left out."""
