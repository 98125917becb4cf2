"""A reader of .proto source text, for places without a compiler.

It covers what schemas need: packages, imports, messages, enums, oneofs, maps,
labels, nested types, reserved ranges and options (of which ``packed``, ``default``
and ``allow_alias`` matter; others are read over).
"""

from __future__ import annotations

import re

from google.protobuf import descriptor_pb2 as pb

_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[A-Za-z_][\w.]*|-?[0-9][\w.+-]*|\.[A-Za-z_][\w.]*|[^\s])", re.DOTALL)
_F = pb.FieldDescriptorProto
_SCALARS = {t.name[5:].lower(): t.number for t in pb.FieldDescriptorProto.Type.DESCRIPTOR.values if t.name not in ("TYPE_GROUP", "TYPE_MESSAGE", "TYPE_ENUM")}
_LABELS = {"optional": _F.LABEL_OPTIONAL, "required": _F.LABEL_REQUIRED, "repeated": _F.LABEL_REPEATED}


class _Reader:
    def __init__(self, text: str):
        self.tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or (expected and token != expected):
            raise ValueError(f"expected {expected or 'more'}, found {token or 'the end'} at token {self.at}")
        self.at += 1
        return token

    def skip_statement(self) -> None:
        depth = 0
        while True:
            token = self.take()
            depth += (token in "{[(") - (token in "}])")
            if token == ";" and not depth or token == "}" and not depth:
                return

    def string(self) -> str:
        return self.take()[1:-1]

    def options(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.peek() != "[":
            return out
        self.take("[")
        while self.peek() != "]":
            name = self.take()
            while self.peek() != "=":
                name += self.take()
            self.take("=")
            out[name] = self.take()
            while self.peek() not in (",", "]"):
                out[name] += self.take()
            if self.peek() == ",":
                self.take()
        self.take("]")
        return out


def parse(text: str, name: str = "inline.proto") -> pb.FileDescriptorProto:
    """The file descriptor of a .proto source; types are resolved when it is loaded into a pool."""
    r = _Reader(text)
    out = pb.FileDescriptorProto(name=name, syntax="proto2")
    while r.peek():
        word = r.take()
        if word == "syntax":
            r.take("=")
            out.syntax = r.string()
            r.take(";")
        elif word == "package":
            out.package = r.take()
            r.take(";")
        elif word == "import":
            if r.peek() in ("public", "weak"):
                r.take()
            out.dependency.append(r.string())
            r.take(";")
        elif word == "message":
            _message(r, out.message_type.add(), out.syntax == "proto3")
        elif word == "enum":
            _enum(r, out.enum_type.add())
        elif word != ";":
            r.skip_statement()
    return out


def _enum(r: _Reader, out: pb.EnumDescriptorProto) -> None:
    out.name = r.take()
    r.take("{")
    while r.peek() != "}":
        name = r.take()
        if name == "option":
            if r.peek() == "allow_alias":
                r.take(), r.take("=")
                out.options.allow_alias = r.take() == "true"
                r.take(";")
            else:
                r.skip_statement()
        elif name == "reserved":
            r.skip_statement()
        elif name != ";":
            r.take("=")
            out.value.add(name=name, number=int(r.take(), 0))
            r.options()
            r.take(";")
    r.take("}")


def _message(r: _Reader, out: pb.DescriptorProto, proto3: bool) -> None:
    out.name = r.take()
    r.take("{")
    presence: list[pb.FieldDescriptorProto] = []
    while r.peek() != "}":
        word = r.take()
        if word == "message":
            _message(r, out.nested_type.add(), proto3)
        elif word == "enum":
            _enum(r, out.enum_type.add())
        elif word == "oneof":
            index = len(out.oneof_decl)
            out.oneof_decl.add(name=r.take())
            r.take("{")
            while r.peek() != "}":
                if r.peek() == "option":
                    r.skip_statement()
                else:
                    _field(r, out, r.take(), _F.LABEL_OPTIONAL).oneof_index = index
            r.take("}")
        elif word in ("option", "reserved", "extensions", "extend"):
            r.skip_statement()
        elif word == "map" and r.peek() == "<":
            _map_field(r, out)
        elif word in _LABELS:
            field = _field(r, out, r.take(), _LABELS[word])
            if proto3 and word == "optional":
                presence.append(field)
        elif word != ";":
            _field(r, out, word, _F.LABEL_OPTIONAL)
    r.take("}")
    for field in presence:  # each optional field of proto3 is the one member of a oneof, after the declared ones
        field.proto3_optional = True
        field.oneof_index = len(out.oneof_decl)
        out.oneof_decl.add(name=f"_{field.name}")


def _typed(field: pb.FieldDescriptorProto, kind: str) -> None:
    if kind in _SCALARS:
        field.type = _SCALARS[kind]
    else:
        field.type_name = kind


def _field(r: _Reader, out: pb.DescriptorProto, kind: str, label: int) -> pb.FieldDescriptorProto:
    field = out.field.add(name=r.take(), label=label)
    _typed(field, kind)
    r.take("=")
    field.number = int(r.take(), 0)
    options = r.options()
    if "packed" in options:
        field.options.packed = options["packed"] == "true"
    if "default" in options:
        field.default_value = options["default"].strip("\"'")
    if "json_name" in options:
        field.json_name = options["json_name"].strip("\"'")
    r.take(";")
    return field


def _map_field(r: _Reader, out: pb.DescriptorProto) -> None:
    r.take("<")
    key = r.take()
    r.take(",")
    value = r.take()
    r.take(">")
    field = _field(r, out, "bytes", _F.LABEL_REPEATED)
    entry = out.nested_type.add(name="".join(p[:1].upper() + p[1:] for p in field.name.split("_")) + "Entry")
    entry.options.map_entry = True
    _typed(entry.field.add(name="key", number=1, label=_F.LABEL_OPTIONAL), key)
    _typed(entry.field.add(name="value", number=2, label=_F.LABEL_OPTIONAL), value)
    field.ClearField("type")
    field.type_name = entry.name


def resolve(files: list[pb.FileDescriptorProto], well_known: list[pb.FileDescriptorProto]) -> None:
    """Give every field of a named type its full type name and kind, by the scoping rules of .proto."""
    kinds: dict[str, int] = {}

    def declare(message: pb.DescriptorProto, scope: str) -> None:
        name = f"{scope}.{message.name}"
        kinds[name] = _F.TYPE_MESSAGE
        for nested in message.nested_type:
            declare(nested, name)
        kinds.update({f"{name}.{e.name}": _F.TYPE_ENUM for e in message.enum_type})

    for f in [*well_known, *files]:
        scope = f".{f.package}" if f.package else ""
        for message in f.message_type:
            declare(message, scope)
        kinds.update({f"{scope}.{e.name}": _F.TYPE_ENUM for e in f.enum_type})

    def settle(message: pb.DescriptorProto, scope: str) -> None:
        name = f"{scope}.{message.name}"
        for field in message.field:
            if field.type_name:
                at, wanted = name, field.type_name
                while not wanted.startswith(".") and f"{at}.{wanted}" not in kinds and at:
                    at = at.rpartition(".")[0]
                full = wanted if wanted.startswith(".") else f"{at}.{wanted}"
                if full not in kinds:
                    raise ValueError(f"{name[1:]}.{field.name}: unknown type {wanted}")
                field.type_name, field.type = full, kinds[full]
        for nested in message.nested_type:
            settle(nested, name)

    for f in files:
        for message in f.message_type:
            settle(message, f".{f.package}" if f.package else "")
