"""Read-only queries that a generator proposes: its request and answer types, and its limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

MOST_RELATIONS, MOST_TEXTS, MOST_BYTES = 128, 16, 4096


class AgentError(RuntimeError):
    pass


class ClarificationRequired(AgentError):
    pass


class QueryDeclined(AgentError):
    pass


def _text(value: str) -> str:
    if not isinstance(value, str) or not value or len(value.encode("utf-8", "replace")) > MOST_BYTES:
        raise ValueError("a text is 1 to 4096 bytes")
    return value


@dataclass(frozen=True)
class RelationContext:
    name: str
    columns: tuple[str, ...]
    derived: bool


@dataclass(frozen=True)
class GenerationRequest:
    question: str
    relations: tuple[RelationContext, ...]
    revision: int


@dataclass(frozen=True)
class QueryProposal:
    sql: str


@dataclass(frozen=True)
class Clarification:
    question: str

    def __post_init__(self) -> None:
        _text(self.question)


@dataclass(frozen=True)
class Decline:
    reason: str

    def __post_init__(self) -> None:
        _text(self.reason)


@dataclass(frozen=True)
class Generation:
    outcome: QueryProposal | Clarification | Decline
    notes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.outcome, (QueryProposal, Clarification, Decline)):
            raise TypeError("an outcome is a proposal, a clarification or a decline")
        if len(self.notes) > MOST_TEXTS:
            raise ValueError("too many notes")
        for note in self.notes:
            _text(note)


@dataclass(frozen=True)
class AgentConfig:
    generator: Callable[[GenerationRequest], Generation]
    relations: tuple[str, ...]
    disclose_schema: bool = False

    def __post_init__(self) -> None:
        if not callable(self.generator):
            raise TypeError("a generator is callable")
        if not 1 <= len(self.relations) <= MOST_RELATIONS or len(set(self.relations)) != len(self.relations):
            raise ValueError("1 to 128 different relations are allowed")
        if any(not isinstance(n, str) or not 1 <= len(n.encode()) <= 64 for n in self.relations):
            raise ValueError("a relation's name is 1 to 64 bytes")
        if type(self.disclose_schema) is not bool:
            raise TypeError("consent is True or False")
