"""The engine's exceptions; each kind of failure has a class of its own."""


class EngineError(Exception):
    """What every other error here is."""


class ConfigError(EngineError):
    """A configuration or an identifier that can't be right."""


class SchemaError(EngineError):
    """A dataset or column that isn't there, or is there twice."""


class UnsupportedDataType(EngineError):
    """A type that has no text form that can be read back."""


class UnsupportedStateVersion(EngineError):
    """A state file of another version."""


class StateError(EngineError):
    """State that can't be read, written or locked."""


class DatabaseError(EngineError):
    """What a database refused."""


class AccessDenied(EngineError):
    """An actor who may not apply a target."""


class UnknownDomain(EngineError):
    """A domain that neither the configuration nor a target names."""


class NoEndpoint(EngineError):
    """A known domain without an endpoint."""


class IndexOutOfRange(EngineError):
    """A row number beyond the dataset."""
