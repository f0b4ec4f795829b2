"""Plug-in models: embedding, caption, role and judge engines as functions over batches.

An engine is a Python callable that takes a pandas frame of its input columns and returns one value per
row (None where it has none).  The defaults stand for absent models: empty captions, no findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import pixels

Engine = Callable[[pd.DataFrame], "list | pd.Series"]


def no_caption(batch: pd.DataFrame) -> list[str]:
    return [""] * len(batch)


def no_findings(batch: pd.DataFrame) -> list[str]:
    return ['{"findings": []}'] * len(batch)


def mock_embeddings(batch: pd.DataFrame) -> list[np.ndarray]:
    return [pixels.mock_embedding(int(w), int(h)) for w, h in zip(batch.width, batch.height)]


def with_model(df: DataFrame, inputs: list[str], engine: Engine, name: str, kind: str, failures: int = 3, rows: int = 64) -> DataFrame:
    """``df`` with the engine's answers in column ``name``.

    Connection failures leave null, the sign that the row still needs work; after ``failures`` in a row a
    task stops asking and leaves the rest null.  A column called ``name`` in ``df`` is replaced."""
    df = df.drop(name)
    schema = f"{df.schema.toDDL()}, `{name}` {kind}" if df.columns else f"`{name}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for pdf in batches:
            answers: list = []
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                if failed >= failures:
                    answers += [None] * len(part)
                    continue
                try:
                    answers += list(engine(part[inputs]))
                    failed = 0
                except (ConnectionError, TimeoutError):
                    failed += 1
                    answers += [None] * len(part)
            yield pdf.assign(**{name: pd.Series(answers, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def once_per(df: DataFrame, key: str, inputs: list[str], engine: Engine, name: str, kind: str) -> DataFrame:
    """As ``with_model``, asking once for each distinct ``key`` instead of once a row."""
    asked = with_model(df.select(key, *inputs).dropDuplicates([key]), inputs, engine, name, kind).select(key, name)
    return df.drop(name).join(asked, key, "left")


def all_pass(answers: Column) -> Column:
    """A pair stands only if every probe answered yes; null, missing and other answers reject it."""
    return F.coalesce(F.forall(answers, lambda a: F.coalesce(F.lower(F.trim(a)) == "yes", F.lit(False))), F.lit(False))


def probed_confidence(confidence: Column, kind: Column, passed: Column, explicit_both: Column) -> Column:
    """0 where a probe failed; of source and receiver findings the probe also grades how explicit they are."""
    graded = F.when(kind == "source_receiver", F.when(explicit_both, F.lit(0.95)).otherwise(F.least(confidence, F.lit(0.75)))).otherwise(confidence)
    return F.when(passed, graded).otherwise(F.lit(0.0))


def looker_is_left(gaze_a: Column, faces_a: Column, gaze_b: Column, faces_b: Column) -> Column:
    """Which image of a gaze pair looks: the one with a single face and a clear look, else the stronger look."""
    a, b = F.abs(F.coalesce(gaze_a, F.lit(0.0))), F.abs(F.coalesce(gaze_b, F.lit(0.0)))
    qa, qb = F.coalesce(faces_a == 1, F.lit(False)) & (a >= 0.22), F.coalesce(faces_b == 1, F.lit(False)) & (b >= 0.22)
    return F.when(qa & ~qb, True).when(qb & ~qa, False).otherwise(a >= b)


def repaired_json(answer: Column, schema: str) -> Column:
    """A model's JSON object out of fences and talk; one that lacks its end is closed after its last whole member.
    Null if that does not help."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*", 0)
    whole = F.regexp_extract(body, r"(?s)^\{.*\}", 0)
    tries = (whole, F.concat(body, F.lit("}")), F.concat(F.regexp_replace(body, r"(?s),[^,]*$", ""), F.lit("}")))
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema)) for t in tries))
