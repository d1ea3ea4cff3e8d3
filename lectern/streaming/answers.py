"""The fold of streamed answers as a stateful stream: one state for each stream of events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.chat import CLIENT, THINKING

_STATE = "answer string, thinking string, called boolean, done boolean"


def _text(event: dict[str, Any], path: str) -> str:
    for key in path.split("."):
        event = event.get(key) if isinstance(event, dict) else None  # type: ignore[assignment]
    return event if isinstance(event, str) else ""


def folded(state: tuple[str, str, bool, bool], line: str, paths: tuple[str, ...] = CLIENT) -> tuple[str, str, bool, bool]:
    """(answer, thinking, whether a call is open, done) after one more line; what isn't a JSON object changes nothing."""
    answer, thinking, called, done = state
    try:
        event = json.loads(line)
    except ValueError:
        return state
    if done or not isinstance(event, dict) or isinstance(event.get("messages"), list):
        return state
    message = event.get("message")
    calls = message.get("tool_calls") if isinstance(message, dict) else None
    called = called or (isinstance(calls, list) and bool(calls))
    piece = next((t for p in paths if (t := _text(event, p))), "")
    thought = next((t for p in THINKING if (t := _text(event, p))), "")
    thinking = "" if piece else thinking + thought
    if event.get("done") is True:
        called, done = False, not called
    return answer + piece, thinking, called, done


def streamed_answers(events: DataFrame, keys: list[str], order: str = "seq", paths: tuple[str, ...] = CLIENT, patience: int | None = 600) -> DataFrame:
    """(keys, answer, thinking, done) for each stream of a streaming ``events`` (keys, order, event), once it ends.

    A stream without an event for ``patience`` seconds of processing time is ended as it is, with done
    false, and its state is dropped; with None such states stay, and a query over what is there can end.
    Events of one micro-batch are taken in ``order``.
    """
    kinds = {k: events.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), _STATE.replace("called boolean, ", "")])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("", "", False, False)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("o", kind="stable")
            for line in rows["event"]:
                if line is not None:
                    now = folded(now, line, paths)
        answer, thinking, _, done = now
        if done or state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([[*key, answer, thinking, done]], columns=[*keys, "answer", "thinking", "done"])
        else:
            state.update(now)
            if patience is not None:
                state.setTimeoutDuration(patience * 1000)

    slim = events.select(*keys, F.col(order).alias("o"), "event")
    timeout = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    return slim.groupBy(*keys).applyInPandasWithState(fold, schema, _STATE, "append", timeout)
