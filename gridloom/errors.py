"""What can go wrong, by kind."""


class CostTableError(Exception):
    """A cost table can't be used."""


class FileLoadError(CostTableError):
    """A cost file can't be read or holds nothing."""


class InvalidSourceError(CostTableError):
    """Neither a file, a mapping nor a table of costs."""


class FormatError(CostTableError):
    """The layout of a cost table does not fit its use."""


class FeatureColumnError(Exception):
    """Feature columns can't be found."""


class NoSuitableColumnsError(FeatureColumnError):
    """No column can be the main feature."""


class ColumnAnalysisError(FeatureColumnError):
    """Statistics of a column can't be made."""


class FeatureServiceError(Exception):
    """A web feature service fails."""


class ServiceConnectionError(FeatureServiceError):
    """The service can't be reached."""


class ResponseParsingError(FeatureServiceError):
    """The service's answer can't be read."""


class LayerNotFoundError(FeatureServiceError):
    """The service has no such layer."""


class SystemMismatchError(ValueError):
    """A box or mask is in another coordinate system than the file it is to be laid on."""

    def __init__(self, what: str, given: int | None = None, there: int | None = None) -> None:
        super().__init__(f"the {what} is in EPSG:{given}, the file in EPSG:{there}")


class RasterShapeError(Exception):
    """A raster has neither two nor three dimensions."""


class NoPathFoundError(Exception):
    """Source and target are not connected."""

    def __init__(self, source: object = None, target: object = None) -> None:
        super().__init__(f"no path from {source} to {target}")


class AlgorithmNotImplementedError(Exception):
    """There is no such algorithm."""


class PairwiseError(Exception):
    """Pairwise routing needs as many sources as targets."""
