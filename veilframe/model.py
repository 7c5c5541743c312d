"""Data model: the detection struct and the policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed

DETECTION = "struct<start:int,end:int,kind:string,text:string,confidence:double,source:string,ord:int,passed:boolean,base:double,boost:double,matched_terms:array<string>,compat:string>"
DETECTIONS = f"array<{DETECTION}>"


@dataclass(frozen=True)
class Policy:
    """What is replaced: ``strict`` all kinds, ``balanced`` lets allowed terms through, ``audit`` replaces nothing.

    ``kinds`` limits the replaced kinds; an empty set means all of them.
    """

    mode: str = "strict"
    allow: tuple[str, ...] = ()
    kinds: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if self.mode not in ("strict", "balanced", "audit"):
            raise ValueError(f"unknown policy mode {self.mode!r}; expected strict, balanced, or audit")
        if unknown := set(self.kinds) - set(fixed.KINDS):
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
