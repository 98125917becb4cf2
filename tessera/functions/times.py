"""Timestamp messages and Python's datetimes, for user functions and messages of the driver."""

from __future__ import annotations

import datetime as dt

from google.protobuf.timestamp_pb2 import Timestamp

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def datetime_of(ts: Timestamp) -> dt.datetime:
    """The moment in UTC, to the microsecond; what is finer is cut off."""
    return _EPOCH + dt.timedelta(seconds=ts.seconds, microseconds=int(ts.nanos / 1000))


def timestamp_of(moment: dt.datetime, kind: type = Timestamp):
    """A message of ``kind`` (one of seconds and nanos); a datetime without a zone counts as UTC."""
    since = (moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)) - _EPOCH
    return kind(seconds=since.days * 86_400 + since.seconds, nanos=since.microseconds * 1000)
