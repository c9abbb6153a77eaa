"""Errors raised on the driver; rows carry the same names in an error_code column."""


class BoxError(ValueError):
    """A box that is not four finite numbers in the order and range asked for."""


class DatasetError(ValueError):
    """A queries file or record that breaks the dataset's rules."""


class OutputError(ValueError):
    """A model output from which no candidate can be read."""


class SettingsError(ValueError):
    """An option outside what is supported."""


class SubmissionError(ValueError):
    """Predictions that do not fit the queries they answer."""
