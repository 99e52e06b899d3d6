
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cohortry.study.tables import Study

Question = Callable[..., DataFrame]

QUESTIONS: dict[str, Question] = {}
_BY_NUMBER: dict[str, str] = {}


def question(*numbers: str) -> Callable[[Question], Question]:
    """Register a function of a study under its own name and its catalogue numbers."""

    def register(build: Question) -> Question:
        if build.__name__ in QUESTIONS:
            raise ValueError(f"two questions named {build.__name__}")
        QUESTIONS[build.__name__] = build
        for number in numbers:
            if number in _BY_NUMBER:
                raise ValueError(f"{number} is answered twice")
            _BY_NUMBER[number] = build.__name__
        return build

    return register


def ask(study: Study, name_or_number: str, **parameters) -> DataFrame:
    """Answer a question by name (``leukopenia``) or catalogue number (``M24``)."""
    name = _BY_NUMBER.get(name_or_number, name_or_number)
    return QUESTIONS[name](study, **parameters)


def numbers() -> dict[str, str]:
    """Catalogue number -> question name."""
    return dict(_BY_NUMBER)
