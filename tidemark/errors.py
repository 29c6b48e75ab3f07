"""What the pipeline raises on purpose."""

from __future__ import annotations


class TidemarkError(Exception):
    """Base of all expected failures."""


class ConfigError(TidemarkError):
    """Settings or rules that cannot be used."""


class MissingFeedError(TidemarkError):
    """A feed file of the batch does not exist."""


class BatchOrderError(TidemarkError):
    """The batch is not the next one, nor the last one again."""


class GateClosedError(TidemarkError):
    """A critical rule failed; nothing was published."""

    def __init__(self, message: str, alert_path: str):
        super().__init__(message)
        self.alert_path = alert_path


class ReconciliationError(TidemarkError):
    """Rows or totals do not balance; nothing was published."""
