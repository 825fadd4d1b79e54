"""Errors raised while a plan is being built."""


class OddledgerError(Exception):
    """Base class of all errors of this package."""


class IngestError(OddledgerError):
    """Input cannot be brought to the transaction schema."""


class ConfigError(OddledgerError):
    """A detector or strategy configuration is not usable."""


class AnalysisError(OddledgerError):
    """An analysis cannot run on the given data."""
