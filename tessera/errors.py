"""Errors of the table layer; each kind is a class, so callers can catch what they handle."""

import re


class TableError(Exception):
    """Base of all errors of this library."""


class NotFound(TableError):
    """A table, namespace, snapshot or file doesn't exist."""


class AlreadyExists(TableError):
    """A namespace or table exists already."""


class ConcurrentModification(TableError):
    """Another commit came first; reload and try again."""


class InvalidInput(TableError):
    """An argument can't be used."""


class InvalidFilter(InvalidInput):
    """A filter text can't be parsed."""


class InvalidSpec(InvalidInput):
    """A partition spec names what isn't there or can't be."""


class InvalidMetadata(TableError):
    """Stored metadata contradicts itself."""


class IncompatibleSchema(TableError):
    """Schemas disagree on a field's type."""


class InvalidPartition(TableError):
    """A partition value is missing or of the wrong type."""


class InvalidFile(TableError):
    """A data file can't be read or isn't what it says."""


class NothingToCommit(TableError):
    """A transaction changes nothing."""


class NothingRegistered(TableError):
    """All files of a registration are in the table already."""


class CompactionFailed(TableError):
    """Some partitions couldn't be compacted."""


class Unsupported(TableError):
    """The catalog or type doesn't offer this."""


class Unauthorized(TableError):
    """A remote catalog refused the credentials."""


class RemoteFailure(TableError):
    """A remote catalog or store failed."""


def from_worker(why: Exception) -> Exception:
    """The error of this library that a Python worker raised, if it is one; else ``why``."""
    found = re.search(r"tessera\.errors\.(\w+): ([^\n]*)", str(why))
    kind = globals().get(found[1]) if found else None
    return kind(found[2]) if isinstance(kind, type) and issubclass(kind, TableError) else why
