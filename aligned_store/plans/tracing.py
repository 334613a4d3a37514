"""What a lake is doing, as the description of its Spark jobs: in the UI, the event log and listeners."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

_DESCRIPTION = "spark.job.description"


def traced(method: Callable) -> Callable:
    """A method of a lake whose jobs are described as "method on path", after what is described already, if anything.

    The caller's description is back afterwards, also if the method fails. A frame that is returned is lazy; the
    jobs that compute it later are the caller's, and described by them.
    """

    @wraps(method)
    def run(self, *args, **kw):
        sc = self.spark.sparkContext
        before = sc.getLocalProperty(_DESCRIPTION)
        mine = f"{method.__name__} on {self.base_path}"
        sc.setLocalProperty(_DESCRIPTION, f"{before} > {mine}" if before else mine)
        try:
            return method(self, *args, **kw)
        finally:
            sc.setLocalProperty(_DESCRIPTION, before)

    return run
