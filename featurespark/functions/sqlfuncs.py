"""SQL functions registered on the query session (usable inside ``where``)."""

from __future__ import annotations

_registered: set[int] = set()


def register_all(session) -> None:
    if id(session) in _registered:
        return
    _registered.add(id(session))
    from featurespark.functions import stsql

    stsql.register(session)
