"""Decoder of the logical replication protocol, version 1, as published in the PostgreSQL manual."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


class ProtocolError(ValueError):
    """Bytes that the protocol doesn't allow."""


UNCHANGED = object()


@dataclass
class Relation:
    oid: int
    namespace: str
    name: str
    #: (name, is key, type oid, type modifier)
    columns: list[tuple[str, bool, int, int]]


@dataclass
class Change:
    """One decoded message.  ``kind``: begin, commit, relation, insert, update, delete, truncate or skipped."""

    kind: str
    position: int = 0
    xid: int = 0
    relation: Relation | None = None
    new: dict | None = None
    old: dict | None = None
    relations: list[int] = field(default_factory=list)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ProtocolError("message ends early")
        self.at += n
        return out

    def number(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "big", signed=signed)

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ProtocolError("text without end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


class Decoder:
    """Keeps the relations announced so far."""

    def __init__(self) -> None:
        self.relations: dict[int, Relation] = {}

    def decode(self, data: bytes) -> Change:
        r = _Reader(data)
        tag = r.take(1)
        if tag == b"B":
            final, _, xid = r.number(8), r.number(8), r.number(4)
            return Change("begin", final, xid)
        if tag == b"C":
            r.number(1)
            r.number(8)
            end = r.number(8)
            return Change("commit", end)
        if tag == b"R":
            return self._relation(r)
        if tag in (b"I", b"U", b"D"):
            return self._row(tag, r)
        if tag == b"T":
            count = r.number(4)
            r.number(1)
            return Change("truncate", relations=[r.number(4) for _ in range(count)])
        if tag in (b"O", b"Y", b"M"):
            return Change("skipped")
        raise ProtocolError(f"unknown message {tag!r}")

    def _relation(self, r: _Reader) -> Change:
        oid, space, name = r.number(4), r.text(), r.text()
        r.number(1)
        columns = []
        for _ in range(r.number(2)):
            key = bool(r.number(1) & 1)
            column = r.text()
            columns.append((column, key, r.number(4), r.number(4, signed=True)))
        self.relations[oid] = Relation(oid, space, name, columns)
        return Change("relation", relation=self.relations[oid])

    def _row(self, tag: bytes, r: _Reader) -> Change:
        oid = r.number(4)
        relation = self.relations.get(oid)
        if relation is None:
            raise ProtocolError(f"relation {oid} was never announced")
        old = new = None
        mark = r.take(1)
        if mark in (b"K", b"O"):
            old = self._tuple(r, relation, keys_only=mark == b"K")
            mark = r.take(1) if tag == b"U" else b""
        if mark == b"N":
            new = self._tuple(r, relation)
        kind = {b"I": "insert", b"U": "update", b"D": "delete"}[tag]
        if kind != "delete" and new is None or kind == "delete" and old is None:
            raise ProtocolError(f"{kind} without a row")
        return Change(kind, relation=relation, new=new, old=old)

    @staticmethod
    def _tuple(r: _Reader, relation: Relation, keys_only: bool = False) -> dict:
        n = r.number(2)
        if n != len(relation.columns):
            raise ProtocolError(f"{n} values for {len(relation.columns)} columns")
        out = {}
        for name, key, _, _ in relation.columns:
            form = r.take(1)
            if form == b"n":
                value = None
            elif form == b"u":
                value = UNCHANGED
            elif form == b"t":
                value = r.take(r.number(4)).decode()
            else:
                raise ProtocolError(f"unknown value form {form!r}")
            if not keys_only or key:
                out[name] = value
        return out


def change_rows(messages: Iterator[bytes], relation_name: str, *, commits: bool = False) -> Iterator[dict]:
    """Rows for :class:`thermocline.streaming.mirror.Mirror`: every change of one relation with its commit position, number within the feed and values as text.

    With ``commits`` every transaction that changed the relation ends with a row of kind ``commit``,
    so that a reader may cut the rows into batches anywhere.
    """
    decoder, pending, number = Decoder(), [], 0
    for data in messages:
        m = decoder.decode(data)
        if m.kind == "begin":
            pending = []
        elif m.kind in ("insert", "update", "delete") and m.relation.name == relation_name:
            number += 1
            new = {k: v for k, v in (m.new or {}).items() if v is not UNCHANGED} if m.new is not None else None
            same = [k for k, v in (m.new or {}).items() if v is UNCHANGED]
            pending.append({"seq": number, "kind": m.kind, "new": new, "old": m.old, "unchanged": same})
        elif m.kind == "truncate" and any(decoder.relations[o].name == relation_name for o in m.relations if o in decoder.relations):
            number += 1
            pending.append({"seq": number, "kind": "truncate", "new": None, "old": None, "unchanged": []})
        elif m.kind == "commit":
            for p in pending:
                yield {"position": m.position, **p}
            if commits and pending:
                number += 1
                yield {"position": m.position, "seq": number, "kind": "commit", "new": None, "old": None, "unchanged": []}
            pending = []
