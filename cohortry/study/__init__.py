"""A clinical study of two patient groups: its tables, and one function per question asked of it."""

from cohortry.study import cognition, exams, labs, people, visits  # noqa: F401  (registers the questions)
from cohortry.study.questions import QUESTIONS, ask
from cohortry.study.tables import SCHEMAS, Study

__all__ = ["QUESTIONS", "SCHEMAS", "Study", "ask"]
