"""What can go wrong while a project is read or queried."""


class LineageError(Exception):
    """Any error of this package."""


class ProjectNotFound(LineageError):
    """The folder has no project file."""


class FileReadError(LineageError):
    """A file can't be read."""


class ArtifactParseError(LineageError):
    """A JSON artifact is malformed or lacks a required field."""


class ModelNotFound(LineageError):
    """No node has the name asked for."""


class CycleDetected(LineageError):
    """The dependencies aren't acyclic."""


class YamlParseError(LineageError):
    """A YAML file is malformed; scans skip such files."""
