"""Writes to several tables that are seen together, logged, and given up when they fail."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from ..schemas import ERROR_CHARS, FAILED, PENDING, ROLLED_BACK, SUCCESS, TRANSACTION_LOG, ConcurrentWriteError
from ..sources.shared import local_frame

#: How often a write is tried on what others have published in between.
ATTEMPTS = 8


class Touched:
    """The versions of tables before a transaction first writes to them."""

    def __init__(self, io):
        self.io, self.before = io, {}

    def __call__(self, target: str) -> str:
        if target not in self.before:
            self.before[target] = self.io.version(target)
        return target


def again(what: Callable, attempts: int = ATTEMPTS):
    """What ``what`` returns, tried anew, a little later each time, while another writer has been faster."""
    for left in reversed(range(attempts)):
        try:
            return what()
        except ConcurrentWriteError:
            if not left:
                raise
            time.sleep(0.05 * (attempts - left) * (1 + uuid.uuid4().int % 8 / 8))


def atomically(io, body: Callable[[Touched], object]):
    """Run ``body``, which tells each table before it writes to it, and publish all of them in one commit of the lake.

    Where another writer has published meanwhile, the body runs anew on what is there then.
    """

    def once():
        io.begin()
        touched = Touched(io)
        try:
            out = body(touched)
            io.publish(touched.before)
            return out
        except BaseException:
            io.undo(touched.before)
            raise

    return again(once)


def transaction(lake, owner: str, signal_type: str, body: Callable[[Touched], object]):
    """:func:`atomically`, logged: pending, then success; or failed and, once nothing of it is left, rolled back."""
    key, started = uuid.uuid4().hex, dt.datetime.now(dt.UTC)

    def log(status: str, error: str | None = None) -> None:
        row = (key, status, owner, signal_type, started, dt.datetime.now(dt.UTC), error[:ERROR_CHARS] if error else None)
        again(lambda: lake.io.write(local_frame(lake.spark, [row], TRANSACTION_LOG), lake.transaction_log))

    lake.ensure_transaction_log()
    log(PENDING)
    try:
        out = atomically(lake.io, body)
    except BaseException as e:
        log(FAILED, f"{type(e).__name__}: {e}")
        log(ROLLED_BACK)
        raise
    log(SUCCESS)
    return out
