"""Errors, with the operation and the collection and document they concern."""

from __future__ import annotations


# Error codes, by hundreds: general, file format, encoding, input and output, columns.
CODES = {
    0: ("Unknown", "InvalidArgument", "NotSupported", "OutOfMemory", "Cancelled", "Timeout"),
    100: ("InvalidMagic", "VersionMismatch", "CorruptedFile", "SchemaMismatch", "MetadataError"),
    200: ("EncodeFailed", "DecodeFailed", "UnsupportedType", "CompressionFailed", "NullNotSupported"),
    300: ("IO", "FileNotFound", "PermissionDenied", "DiskFull", "BrokenPipe", "UnexpectedEOF"),
    400: ("ColumnNotFound", "PageNotFound", "TypeMismatch", "BufferTooSmall"),
}


class StellateError(Exception):
    """code: a name of CODES; severity: warning (try again), error, or fatal (what is stored is unusable)."""

    recoverable = True
    code = "InvalidArgument"

    @property
    def severity(self) -> str:
        return "fatal" if not self.recoverable else "warning" if self.code in ("Cancelled", "Timeout") else "error"

    @property
    def category(self) -> int:
        return next(c for c, names in CODES.items() if self.code in names)

    def __init__(self, op: str = "", detail: str = "", collection: str = "", document: str = ""):
        self.op, self.detail, self.collection, self.document = op, detail, collection, document
        where = "/".join(x for x in (collection, document) if x)
        super().__init__(": ".join(x for x in (op, where, type(self).__doc__ or type(self).__name__, detail) if x))


class DocumentNotFoundError(StellateError):
    """document not found"""


class DuplicateIDError(StellateError):
    """document ID already exists"""


class InvalidDocumentError(StellateError):
    """invalid document"""

    code = "SchemaMismatch"


class DimensionMismatchError(InvalidDocumentError):
    """vector dimension mismatch"""


class CollectionNotFoundError(StellateError):
    """collection not found"""


class CollectionClosedError(StellateError):
    """collection is closed"""


class EmptyIndexError(StellateError):
    """index is empty"""


class IndexCorruptedError(StellateError):
    """index is corrupted"""

    recoverable, code = False, "CorruptedFile"


class VersionError(StellateError):
    """format version is not supported"""

    recoverable, code = False, "VersionMismatch"


class VersionConflictError(StellateError):
    """another writer was first"""

    code = "Cancelled"


class OperationTimeoutError(StellateError):
    """operation took too long and was cancelled"""

    code = "Timeout"


def is_not_found(e: Exception) -> bool:
    return isinstance(e, (DocumentNotFoundError, CollectionNotFoundError))


def is_fatal(e: Exception) -> bool:
    return isinstance(e, StellateError) and not e.recoverable


def is_recoverable(e: Exception) -> bool:
    return getattr(e, "recoverable", False)
