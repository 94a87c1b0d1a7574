"""Requests for a predictor, and running one in batches."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.functions.parsing import extract_reply

# Fixed value: the prompt that the predictions are made with.
SYSTEM = (
    "The dataset contains utterances from Friends TV series. "
    "Each utterance in a dialog can be of positive, negative or neutral sentiment. "
    "Please classify the given sample by answering with exactly one word: "
    "neutral, negative or positive."
)
CONTENT = "struct<type: string, text: string, video: string, audio: string>"


def _content(kind: str, value: Column) -> Column:
    fields = [F.lit(kind).alias("type")] + [(value if f == kind else F.lit(None).cast("string")).alias(f) for f in ("text", "video", "audio")]
    return F.struct(*fields)


def build_request(modalities: Column, text: Column, video: Column, audio: Column, system: str = SYSTEM) -> Column:
    """Chat request: the system's prompt, then a user message with the enabled modalities in the order video, audio, text."""
    parts = F.filter(F.array(_content("video", video), _content("audio", audio), _content("text", text)), lambda x: F.array_contains(modalities, x["type"]))
    prompt = F.array(_content("text", F.lit(system)))
    return F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content")), F.struct(F.lit("user").alias("role"), parts.alias("content")))


#: The model that a worker process keeps from task to task, by the run that asked for it; one at a time.
MODELS: dict[str, Callable] = {}


def model_of(run: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model of a run, loaded when it is first asked for. (As a function of the module, it is the worker's own.)"""
    if run not in MODELS:
        MODELS.clear()
        MODELS[run] = load()
    return MODELS[run]


def answers(predictor: Callable[[pd.DataFrame], list], given: pd.DataFrame) -> list[tuple]:
    """(transcript, error, traceback) for each row. A batch that fails, or whose answers are not as many as its rows, is
    halved until the failure is one row's own error; an answer that is no text is its row's error."""
    try:
        got = list(predictor(given))
        if len(got) != len(given):
            raise ValueError(f"{len(got)} answers to {len(given)} rows")
        return [(t, None, None) if isinstance(t, str) else (None, "no answer" if t is None else f"the answer is no text but {type(t).__name__}", None) for t in got]
    except Exception as e:
        if len(given) == 1:
            return [(None, str(e), traceback.format_exc())]
    half = len(given) // 2
    return answers(predictor, given.iloc[:half]) + answers(predictor, given.iloc[half:])


def pieces(given: pd.DataFrame, inputs: list[str], most: int | None) -> Iterator[pd.DataFrame]:
    """A batch in pieces whose inputs have at most so many bytes, or of one row."""
    if not most:
        yield given
        return
    size = sum((given[c].map(lambda v: len(v.encode()) if isinstance(v, str) else 8) for c in inputs), start=pd.Series(0, index=given.index)).tolist()
    a, held = 0, 0
    for b, n in enumerate(size):
        if b > a and held + n > most:
            yield given.iloc[a:b]
            a, held = b, 0
        held += n
    yield given.iloc[a:]


def batch_predict(
    rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], carry: list[str], inputs: list[str], slots: int | None = None, batch_bytes: int | None = None, profile: ResourceProfile | None = None
) -> DataFrame:
    """rows' `carry` columns with transcript, error, traceback.

    load() is called once in each worker process, which keeps the predictor for its later tasks. The predictor takes a
    batch (the `inputs`) and returns a transcript for each row; what fails, is missing or is no text becomes an error
    row, so that each row comes out once.
    slots: tasks that run the predictor (its accelerators); rows are dealt evenly to them. batch_bytes: bytes of a batch's
    inputs at most, but for one large row. profile: the executors that these tasks need, such as those with an accelerator; the stages before
    run on others. The predictor runs again each time the result is computed: write it, at best by write_outcomes."""
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField(c, T.StringType()) for c in ("transcript", "error", "traceback")])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch, inputs, batch_bytes):
                if len(part):
                    got = pd.DataFrame(answers(model_of(name, load), part[inputs]), columns=["transcript", "error", "traceback"], dtype=object)
                    yield pd.concat([part[carry].reset_index(drop=True), got], axis=1)

    need = list(dict.fromkeys([*carry, *inputs]))
    dealt = rows.select(*need) if slots is None else rows.select(*need).repartition(slots)
    return dealt.mapInPandas(run, schema, profile=profile)


def with_outcome(results: DataFrame) -> DataFrame:
    """results with prediction (the reply taken from the transcript) and outcome, "predicted" or "failed"."""
    good = F.col("error").isNull()
    rows = results.withColumns({"prediction": F.when(good, extract_reply(F.col("transcript"))), "outcome": F.when(good, "predicted").otherwise("failed")})
    return rows.drop("transcript")


def route_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, errors) of results that are already written; what is not runs the predictor for either (see
    write_outcomes)."""
    rows = with_outcome(results)
    return rows.filter("outcome = 'predicted'").drop("error", "traceback", "outcome"), rows.filter("outcome = 'failed'").drop("prediction", "outcome")
