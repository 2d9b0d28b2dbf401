"""Calls over a stream whose failed rows wait in state, and not in a task that sleeps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chat import RESULT, bindings, envelope
from ..operators.prompt import Prompt, load_prompt, render_columns
from ..operators.providers import LlmOptions, Provider
from ..operators.retry import RETRIES, WAIT_LEAST, WAIT_MOST, Fatal, Transient
from ..operators.schema import problems, to_json_schema

#: Kept of a row that waits: its prompt and pass-through data, the errors so far.
WAITING = "prompt string, passthrough_data string, errors array<string>"


def wait_after(attempt: int) -> float:
    """Seconds until the next attempt after so many failed ones (from 1): from the least wait to the most, exponentially."""
    return WAIT_LEAST * (WAIT_MOST / WAIT_LEAST) ** ((attempt - 1) / (RETRIES - 1))


def call_stream(rows: DataFrame, prompt: str | dict | Prompt, provider: Provider, model: str, options: LlmOptions = LlmOptions(), id_col: str = "id", longest_ms: int | None = None) -> DataFrame:
    """Result rows of a prompt over a stream: id and passthrough_data (JSON text), status, errors, response, token_usage.

    Each row is called once when it comes. If the failure is worth another attempt, its prompt and errors go to the
    state of its id, with a timer; the attempt is made in the batch after the timer, up to the number
    of the retry policy. So no task sleeps, and a row that waits outlives a restart. State and results
    of a batch are committed together: a row whose answer was committed has no state and isn't called again, while calls of a batch that
    was lost before may be. Rows with skip_processing are skipped at once. ids are unique; several rows of one
    id in one batch are called each, but only the last of them can wait. longest_ms bounds waits (for tests).
    """
    prompt = load_prompt(prompt)
    prompt.check()
    schema = to_json_schema(prompt.response_schema)
    records = envelope(rows.withColumn("_seq", F.lit(0).cast("long")), id_col)  # a stream has no places
    asked = records.select("id", "passthrough_data", F.coalesce("skip_processing", F.lit(False)).alias("skip"), F.to_json(render_columns(prompt, bindings(records)), {"ignoreNullFields": "false"}).alias("prompt"))
    fields = T._parse_datatype_string(f"id string, passthrough_data string, {RESULT}")
    names = [f.name for f in fields]

    def once(asked_for: str) -> tuple[str, str | None, str | None, dict | None]:
        """(ok, again or failed, error, response, usage) of one attempt."""
        try:
            done = provider.complete(model, json.loads(asked_for), schema, options)
            if found := problems(done.response, schema):
                raise Transient(f"the response doesn't fit the schema: {'; '.join(found[:5])}")
        except Transient as e:
            return "again", str(e), None, None
        except Fatal as e:
            return "failed", str(e), None, None
        usage = None if done.prompt_tokens is None or done.completion_tokens is None else {"prompt_tokens": done.prompt_tokens, "completion_tokens": done.completion_tokens}
        return "ok", None, json.dumps(done.response, ensure_ascii=False, separators=(",", ":")), usage

    def call(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            waiting = [(*state.get, False)]
            state.remove()
        else:
            waiting = [(p, d, [], bool(s)) for pdf in frames for p, d, s in zip(pdf["prompt"], pdf["passthrough_data"], pdf["skip"], strict=True)]
        out = []
        for text, passed, errors, skip in waiting:
            if skip:
                out.append((key[0], passed, "skipped", [], None, None))
                continue
            kind, error, response, usage = once(text)
            errors = [*errors, *([error] if error is not None else [])]
            if kind == "again" and len(errors) <= RETRIES:
                state.update((text, passed, errors))
                wait = int(1000 * wait_after(len(errors))) + 1
                state.setTimeoutDuration(wait if longest_ms is None else min(wait, longest_ms))
            else:
                out.append((key[0], passed, "ok" if kind == "ok" else "failed", errors, response, usage))
        yield pd.DataFrame(out, columns=names)

    return asked.groupBy("id").applyInPandasWithState(call, fields, T._parse_datatype_string(WAITING), "append", GroupStateTimeout.ProcessingTimeTimeout)
