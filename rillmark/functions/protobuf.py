"""Protobuf messages by a descriptor set, read from the wire format."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

DEPTH = 100
# fixed values: field types by their number in a descriptor
_ZIGZAG = {17, 18}
_VARINT = {3: 64, 4: 64, 5: 32, 8: 1, 13: 32, 14: 32, 17: 32, 18: 64}  # and their bits
_FIXED = {1: "<d", 2: "<f", 6: "<Q", 7: "<I", 15: "<i", 16: "<q"}
_SIGNED = {3, 5, 14}
_BOOL, _STRING, _MESSAGE, _BYTES, _ENUM = 8, 9, 11, 12, 14


def varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while shift < 70:
        if at >= len(raw):
            raise ValueError("truncated message")
        out |= (raw[at] & 0x7F) << shift
        at += 1
        if raw[at - 1] < 0x80:
            return out & (1 << 64) - 1, at
        shift += 7
    raise ValueError("overlong number")


def parts(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and value (a number, or the bytes) of each field; groups are passed over."""
    at, groups = 0, []
    while at < len(raw):
        tag, at = varint(raw, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise ValueError("field number 0")
        if wire == 0:
            value, at = varint(raw, at)
        elif wire in (1, 2, 5):
            n, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(raw, at)
            if at + n > len(raw):
                raise ValueError("truncated message")
            value, at = raw[at : at + n], at + n
        elif wire == 3:
            groups.append(number)
            continue
        elif wire == 4 and groups and groups.pop() == number:
            continue
        else:
            raise ValueError(f"wire type {wire}")
        if not groups:
            yield number, wire, value
    if groups:
        raise ValueError("truncated message")


@dataclass
class Field:
    name: str
    kind: int
    repeated: bool
    type_name: str


@dataclass
class Types:
    """Messages and enums of a descriptor set, by their full names behind a dot."""

    messages: dict[str, dict[int, Field]] = field(default_factory=dict)
    maps: set[str] = field(default_factory=set)
    enums: dict[str, dict[int, str]] = field(default_factory=dict)

    def _enum(self, prefix: str, raw: bytes) -> None:
        name, values = "", {}
        for number, _, value in parts(raw):
            if number == 1:
                name = value.decode()
            elif number == 2:
                entry = {n: v for n, _, v in parts(value)}
                values[_signed(entry.get(2, 0), 32)] = entry[1].decode()
        self.enums[f"{prefix}.{name}"] = values

    def _message(self, prefix: str, raw: bytes) -> None:
        found = list(parts(raw))
        name = prefix + "." + next(v.decode() for n, _, v in found if n == 1)
        own: dict[int, Field] = {}
        for number, _, value in found:
            if number == 2:
                f = {n: v for n, _, v in parts(value)}
                plain = f[1].decode()
                own[f[3]] = Field(f[10].decode() if 10 in f else camel(plain), f[5], f.get(4) == 3, f.get(6, b"").decode())
            elif number == 3:
                self._message(name, value)
            elif number == 4:
                self._enum(name, value)
            elif number == 7 and any(n == 7 and v for n, _, v in parts(value)):
                self.maps.add(name)
        self.messages[name] = own


def types_of(descriptor: bytes) -> Types:
    out = Types()
    for number, _, file in parts(descriptor):
        if number == 1:
            found = list(parts(file))
            package = next((v.decode() for n, _, v in found if n == 2), "")
            for n, _, value in found:
                if n == 4:
                    out._message(f".{package}" if package else "", value)
                elif n == 5:
                    out._enum(f".{package}" if package else "", value)
    return out


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> bits - 1 else value


class Decoder:
    def __init__(self, types: Types):
        self.types = types

    def _number(self, f: Field, raw: int) -> int | bool | str:
        bits = _VARINT[f.kind]
        if f.kind == _BOOL:
            return raw != 0
        if f.kind in _ZIGZAG:
            raw &= (1 << bits) - 1
            return raw >> 1 ^ -(raw & 1)
        value = _signed(raw, bits) if f.kind in _SIGNED else raw & (1 << bits) - 1
        return self.types.enums.get(f.type_name, {}).get(value, value) if f.kind == _ENUM else value

    def _values(self, f: Field, wire: int, value: int | bytes, depth: int) -> list:
        """What a field of the wire holds; nothing where its wire type is not that of the field."""
        if f.kind in _VARINT:
            if wire == 0:
                return [self._number(f, value)]
            if wire == 2 and f.repeated:
                out, at = [], 0
                while at < len(value):
                    raw, at = varint(value, at)
                    out.append(self._number(f, raw))
                return out
        elif f.kind in _FIXED:
            size = struct.calcsize(_FIXED[f.kind])
            if wire == (1 if size == 8 else 5):
                return list(struct.unpack(_FIXED[f.kind], value))
            if wire == 2 and f.repeated:
                if len(value) % size:
                    raise ValueError("truncated message")
                return [x[0] for x in struct.iter_unpack(_FIXED[f.kind], value)]
        elif wire == 2:
            if f.kind == _STRING:
                return [value.decode("utf-8")]
            return [base64.b64encode(value).decode()] if f.kind == _BYTES else [self.message(f.type_name, value, depth + 1)]
        return []

    def message(self, name: str, raw: bytes, depth: int = 0) -> dict:
        if depth > DEPTH:
            raise ValueError("messages too deep")
        known, out = self.types.messages[name], {}
        for number, wire, value in parts(raw):
            f = known.get(number)
            for x in self._values(f, wire, value, depth) if f else ():
                if f.type_name in self.types.maps:
                    entry = self._entry(f.type_name, x)
                    out.setdefault(f.name, {}).update(entry)
                elif f.repeated:
                    out.setdefault(f.name, []).append(x)
                elif f.kind == _MESSAGE and f.name in out:
                    out[f.name] = merged(out[f.name], x)
                else:
                    out[f.name] = x
        return out

    def _entry(self, name: str, entry: dict) -> dict:
        """A map's entry; a key or value that is not there is its type's zero."""
        key, value = (self.types.messages[name][i] for i in (1, 2))
        k = entry.get(key.name, self._zero(key))
        return {(str(k).lower() if isinstance(k, bool) else str(k)): entry.get(value.name, self._zero(value))}

    def _zero(self, f: Field):
        if f.kind == _ENUM:
            return self.types.enums.get(f.type_name, {}).get(0, 0)
        return "" if f.kind in (_STRING, _BYTES) else {} if f.kind == _MESSAGE else False if f.kind == _BOOL else 0


def merged(a: dict, b: dict) -> dict:
    """The later of two values of one message: lists add up, messages merge."""
    out = dict(a)
    for k, v in b.items():
        old = out.get(k)
        out[k] = old + v if isinstance(old, list) and isinstance(v, list) else merged(old, v) if isinstance(old, dict) and isinstance(v, dict) else v
    return out


def messages(descriptor: bytes, message: str) -> Callable[[bytes], list[dict]]:
    """A function from a value to its one message."""
    decoder, name = Decoder(types_of(bytes(descriptor))), "." + message.lstrip(".")
    if name not in decoder.types.messages:
        raise LookupError(f"no message {message}")
    return lambda raw: [decoder.message(name, bytes(raw))]
