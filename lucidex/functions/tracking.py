"""Tracing of driver-side calls: a context that logs what a step took and, for DataFrames, how many rows went through."""

from __future__ import annotations

import asyncio
import functools
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@contextmanager
def step(name: str, log: logging.Logger, level: int, fields: dict, announced: bool):
    """Log a step's fields and seconds when it has ended well."""
    if announced:
        log.log(level, "start %s", fields)
    began = time.monotonic()
    yield fields
    log.log(level, "tracker %s", fields | {"duration_": round(time.monotonic() - began, 3)})


def tracked(f: Callable | None = None, *, log: logging.Logger | None = None, inputs: bool = False, outputs: bool = False, announced: bool = False, level: int = logging.INFO):
    """Decorate a function or coroutine so that its calls are logged, with arguments and result if asked for."""
    if f is None:
        return functools.partial(tracked, log=log, inputs=inputs, outputs=outputs, announced=announced, level=level)
    own = log or logging.getLogger(f.__module__)

    def fields(args: tuple, named: dict) -> dict:
        given = {f"args_{k}": v for k, v in [*named.items(), *enumerate(args)]} if inputs else {}
        return {"function_": f.__name__} | given

    def ended(said: dict, value):
        if outputs:
            said["return_"] = value
        return value

    if asyncio.iscoroutinefunction(f):

        @functools.wraps(f)
        async def later(*args, **named):
            with step(f.__name__, own, level, fields(args, named), announced) as said:
                return ended(said, await f(*args, **named))

        return later

    @functools.wraps(f)
    def now(*args, **named):
        with step(f.__name__, own, level, fields(args, named), announced) as said:
            return ended(said, f(*args, **named))

    return now


def counted(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, Observation]:
    """df with an observation of its rows and of those that meet each condition, made in the pass that reads it."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen
