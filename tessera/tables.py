"""Message types over the driver's tables."""

from __future__ import annotations

from tessera.plans.descriptors import ProtoSchema

SHOP = ProtoSchema.from_text(
    shop="""
syntax = "proto3";
package shop;
import "google/protobuf/any.proto";
import "google/protobuf/timestamp.proto";
import "google/protobuf/wrappers.proto";

message LineItem {
  enum ReturnFlag { UNKNOWN_FLAG = 0; A = 1; N = 2; R = 3; }
  enum LineStatus { UNKNOWN_LINE = 0; F = 1; O = 2; }
  int64 l_orderkey = 1;
  int64 l_partkey = 2;
  int32 l_linenumber = 3;
  double l_quantity = 4;
  double l_extendedprice = 5;
  ReturnFlag l_returnflag = 6;
  LineStatus l_linestatus = 7;
  google.protobuf.Timestamp l_shipdate = 8;
}
message Money { int64 units = 1; int32 cents = 2; }
message Order {
  enum Status { UNKNOWN_STATUS = 0; F = 1; O = 2; P = 3; }
  int64 o_orderkey = 1;
  int64 o_custkey = 2;
  Status o_orderstatus = 3;
  double o_totalprice = 4;
  google.protobuf.Timestamp o_orderdate = 5;
  string o_orderpriority = 6;
  repeated LineItem items = 7;
}
message Priced { int64 o_orderkey = 1; Money price = 2; }
message Nation { int32 n_nationkey = 1; string n_name = 2; int32 n_regionkey = 3; }
message Customer { int64 c_custkey = 1; string c_name = 2; Nation nation = 3; double c_acctbal = 4; }
message Event {
  int64 event_id = 1;
  google.protobuf.Timestamp ts = 2;
  string event_type = 3;
  google.protobuf.DoubleValue value = 4;
  map<string, int64> props = 5;
  oneof payload { int64 click_user = 6; double purchase_value = 7; string other = 8; }
}
message Envelope { int64 id = 1; google.protobuf.Any action = 2; }
message Embedding { int64 vec_id = 1; repeated float embedding = 2; google.protobuf.Int32Value label = 3; }
message Document { int64 doc_id = 1; bytes body = 2; string lang = 3; }
message Counter { int64 id = 1; uint32 narrow = 2; uint64 wide = 3; }
""",
    closed="""
syntax = "proto2";
package closed;
message Job {
  enum State { DONE = 1; OPEN = 2; }
  required int64 id = 1;
  optional State state = 2;
  repeated State history = 3 [packed = true];
}
""",
)
