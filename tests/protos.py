"""Message types that the tests use."""

from tessera.plans.descriptors import ProtoSchema

#: A closed enum without 0, a nested enum, an empty message, bytes, packed numbers, a map, recursion.
HARBOR = ProtoSchema.from_text(
    harbor="""
syntax = "proto2";
package harbor;
enum Waters { COASTAL = 3; OCEAN = 7; }
message Ballast {}
message Berth { optional int32 pier = 1; optional double depth = 4; optional string mooring = 2; }
message Engine {
  enum Fuel { DIESEL = 0; STEAM = 2; }
  optional float power = 2; optional Fuel fuel = 6;
}
message Vessel {
  optional int64 registry = 1; optional string callsign = 3; repeated uint32 tanks = 4 [packed = true]; optional Waters waters = 5;
  optional Engine engine = 8; repeated Berth calls = 9; repeated string flags = 10; optional Ballast ballast = 14; optional bytes seal = 20;
}
message Ledger { map<string, double> dues = 2; }
message Parcel { optional uint32 weight = 1; optional bytes stamp = 3; }
message Chain { optional int32 links = 1; optional Chain rest = 4; }
"""
)

#: A field of each Spark type, required, optional, or without presence.
_GAUGE = {"whole": "int32", "big": "int64", "count": "uint32", "tally": "uint64", "level": "double", "ratio": "float", "open": "bool", "note": "string", "raw": "bytes"}


def _gauges(label: str) -> str:
    return " ".join(f"{label}{kind} {name} = {11 + i};" for i, (name, kind) in enumerate(_GAUGE.items()))


GAUGES = ProtoSchema.from_text(
    gauges2=f'syntax = "proto2"; package gauges2; message Strict {{ {_gauges("required ")} }} message Loose {{ {_gauges("optional ")} }}',
    gauges3=f'syntax = "proto3"; package gauges3; message Plain {{ {_gauges("")} }} message Known {{ int32 always = 2; optional int32 maybe = 5; }}',
)

TIDES = ProtoSchema.from_text(
    tides="""
syntax = "proto3"; package tides;
import "google/protobuf/timestamp.proto";
import "google/protobuf/wrappers.proto";
message Reading {
  google.protobuf.DoubleValue water_height = 2; google.protobuf.StringValue station = 3;
  repeated google.protobuf.Int64Value counts = 4; repeated google.protobuf.BoolValue alarms = 6;
}
message Mark { google.protobuf.Timestamp seen_at = 3; }
message Logbook { map<string, Mark> marks = 5; }
"""
)

_KINDS = ["int32", "uint32", "sint32", "fixed32", "sfixed32", "int64", "uint64", "sint64", "fixed64", "sfixed64", "double", "float", "bool", "string", "bytes"]


def _all_types(proto3: bool) -> str:
    label = "" if proto3 else "optional "
    zero = "UNKNOWN = 0; " if proto3 else ""
    singles = " ".join(f"{label}{k} o_{k} = {i + 1}; repeated {k} r_{k} = {i + 21};" for i, k in enumerate(_KINDS))
    required = "" if proto3 else " ".join(f"required {k} q_{k} = {i + 41};" for i, k in enumerate(_KINDS))
    maps = " ".join(f"map<int32, {k}> m_{k} = {i + 61};" for i, k in enumerate(_KINDS))
    name = "all3" if proto3 else "all2"
    return f"""
syntax = "proto{3 if proto3 else 2}"; package {name};
import "google/protobuf/timestamp.proto"; import "google/protobuf/duration.proto"; import "google/protobuf/any.proto";
enum Foreign {{ {zero}FOREIGN_FOO = 4; FOREIGN_BAR = 5; }}
message Scalars {{ {singles} {required} }}
message Maps {{ {maps} map<string, int32> by_name = 80; map<int32, Foreign> m_enum = 81; map<int32, Level> m_message = 82; }}
message Level {{ {label}bytes c = 1; repeated Level2 below = 2; message Level2 {{ {label}string a = 1; {label}Foreign e = 2; }} }}
message Rest {{
  enum Nested {{ {zero}FOO = 1; BAR = 2; NEG = -1; }}
  {label}Nested e = 1; repeated Nested es = 2; repeated Foreign packed = 3 [packed = true]; {label}Level level = 4; repeated Level levels = 5;
  oneof choice {{ uint32 number = 111; Level nested = 112; string text = 113; bytes raw = 114; Foreign kind = 115; }}
  {label}google.protobuf.Timestamp at = 6; repeated google.protobuf.Duration spans = 7; {label}google.protobuf.Any any = 8;
}}
"""


ALL = ProtoSchema.from_text(all2=_all_types(False), all3=_all_types(True))
#: What a reader knows of wider files.
CARGO = ProtoSchema.from_text(
    cargo="""
syntax = "proto3"; package cargo;
message Stamp { string code = 3; }
message Crate { int32 weight = 2; Stamp stamp = 7; string label = 5; }
message Manifest { repeated Crate crates = 4; }
"""
)
