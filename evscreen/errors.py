"""Failures by the part of the workflow that refuses to go on."""


class ScreeningError(ValueError):
    """Base of all refusals."""


class InputError(ScreeningError):
    """Records, labels or configurations break their contract."""


class VoteError(ScreeningError):
    """Votes outside the domain, or none."""


class ConfidenceError(ScreeningError):
    """Thresholds or payloads of confidence scoring."""


class AgreementError(ScreeningError):
    """Agreement without comparable ratings."""


class CorrelationError(ScreeningError):
    """Error correlation without aligned predictions."""


class RecallError(ScreeningError):
    """Strata that can't support a recall estimate."""


class AuditError(ScreeningError):
    """Audit draws, labels or planes that don't fit."""


class AdjudicationError(ScreeningError):
    """Human decisions where none belong, or missing ones."""


class ReviewError(ScreeningError):
    """Review selections outside their limits."""


class AblationError(ScreeningError):
    """Subsets without votes or gold labels."""


class DriftError(ScreeningError):
    """Reference sets and evaluations that don't match."""


class ProvenanceError(ScreeningError):
    """Change logs, protocols and manifests."""


class StoreError(ScreeningError):
    """Conflicting or missing artifacts of a run."""


class ReplyError(ScreeningError):
    """Replies without exactly one rating."""


class ModelDriftError(ScreeningError):
    """A rater that isn't the version it was configured as."""


class BatchJobError(RuntimeError):
    """Batch jobs that failed or conflict."""


class CommandError(Exception):
    """Wrong use of the command line."""
