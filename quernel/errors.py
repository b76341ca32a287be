"""Everything the engine raises on purpose."""


class QuernelError(Exception):
    """Root of all of them."""


class ParseError(QuernelError):
    """The model file cannot be read."""


class ModelIoError(ParseError):
    pass


class YamlError(ParseError):
    pass


class SelectError(QuernelError):
    """No single answer to which dataset serves a query."""


class NoFeasibleDataset(SelectError):
    pass


class NoDatasetsInModel(SelectError):
    pass


class AmbiguousDatasetGroup(SelectError):
    pass


class ResolveError(QuernelError):
    """A name in the request means nothing here."""


class ModelNotFound(ResolveError):
    pass


class DimensionNotFound(ResolveError):
    pass


class DatasetGroupNotFound(ResolveError):
    pass


class AttributeNotFound(ResolveError):
    pass


class MeasureNotFound(ResolveError):
    pass


class MetricNotFound(ResolveError):
    pass


class InvalidAttributeFormat(ResolveError):
    pass


class MetaAttributeNotSet(ResolveError):
    pass


class PlanError(QuernelError):
    """The request cannot be planned."""


class EmptyQuery(PlanError):
    pass


class InvalidQuery(PlanError):
    pass


class SourceError(QuernelError):
    """A source or its path template cannot be resolved."""
