"""Errors of the search engine."""

from __future__ import annotations


class SearchError(Exception):
    pass


class DocumentNotFound(SearchError):
    def __init__(self, key: object) -> None:
        super().__init__(f"no document with id {key!r}")
        self.key = key


class DocumentAlreadyExists(SearchError):
    def __init__(self, key: object) -> None:
        super().__init__(f"there is a document with id {key!r} already")
        self.key = key


class PropertyNotSearchable(SearchError):
    def __init__(self, name: str) -> None:
        super().__init__(f"property {name!r} can't be searched")
        self.name = name


class LanguageNotSupported(SearchError):
    def __init__(self, language: str) -> None:
        super().__init__(f"language {language!r} isn't supported")
        self.language = language


class DocumentsDiffer(SearchError):
    """Columns of given documents aren't those of the documents that are there."""
