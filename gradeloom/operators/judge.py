"""Language-model judges: prompts, fan-out, calls, validation, folding. The model is a pluggable backend."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import shared_table

#: Prompt rows up to which a fan-out broadcasts them; more are joined as Spark sees fit.
MOST_PROMPTS = 10_000
RESULT = "id string, mode string, metric string, expected array<string>, result string, finish string, error string"
#: A backend answers prompts: (prompts, temperature) -> list of (text, finish reason). It may raise ValueError for a retry.
Backend = Callable[[list[str], float], list[tuple[str, str]]]


def stub_backend(prompts: list[str], temperature: float) -> list[tuple[str, str]]:
    """Deterministic answers for tests: each expected key gets a score from the prompt's length."""
    return [(json.dumps({k: 1 + (len(p) + i) % 10 for i, k in enumerate(re.findall(r'"(.*?)"\s*:\s*<score_integer>', p))} or {"score": 1 + len(p) % 10}), "stop") for p in prompts]


def expected_keys(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r'"(.*?)"\s*:\s*<score_integer>'), F.lit(1))


def render(template: Column, instruction: Column, output: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{instruction}"), F.coalesce(instruction, F.lit(""))), F.lit("{output}"), F.coalesce(output, F.lit("")))


def fan_out(records: DataFrame, prompts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """A task for each record and prompt (mode, metric, template). The prompts go along as one array on every record, so there is no join; they are read first, at most ``MOST_PROMPTS``."""
    if done is not None:
        from .merging import resume

        records = resume(records, done)
    rows = prompts.select("mode", "metric", "template").limit(MOST_PROMPTS + 1).collect()
    if len(rows) > MOST_PROMPTS:
        raise ValueError(f"more than {MOST_PROMPTS} prompts")
    kind = "array<struct<mode:string,metric:string,template:string>>"
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.asDict().items())) for r in rows)).cast(kind)
    tasks = records.select("id", "instruction", "output", F.explode(listed).alias("p")).select("id", "instruction", "output", "p.*")
    return tasks.select(F.col("id").cast("string").alias("id"), "mode", "metric", render(F.col("template"), F.col("instruction"), F.col("output")).alias("prompt"), expected_keys(F.col("template")).alias("expected"))


def answer_error(text: str | None, finish: str | None, expected: list[str], reasons: tuple[str, ...] = ("reason",)) -> str | None:
    """What is wrong with one answer; the same rules as ``validation_error``, for asking again at once."""
    if finish in ("length", "content_filter"):
        return "cut off" if finish == "length" else "filtered"
    try:
        found = json.loads(text or "")
    except ValueError:
        return "no JSON object"
    if not isinstance(found, dict):
        return "no JSON object"
    found = {k: v for k, v in found.items() if k not in reasons}
    if expected and set(found) != set(expected):
        return "other keys"
    if not found:
        return "empty"
    whole = [re.fullmatch(r"\s*[+-]?\d{1,4}\s*", str(v)) if not isinstance(v, bool) else None for v in found.values()]
    return None if all(m and 1 <= int(m[0]) <= 10 for m in whole) else "bad score"


def call(tasks: DataFrame, backend: Backend = stub_backend, retries: int = 3, temperature: float = 0.1, batch: int = 64, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks the backend batch by batch inside each task, and checks every answer there. Only prompts without a valid answer are asked
    again, hotter, after 2 ** attempt seconds; where a batch as a whole fails its prompts are asked one by one, so that one bad
    prompt costs one error. Columns: those of ``tasks`` but the prompt, result, finish, error."""

    def ask(prompts: list[str], heat: float) -> list[tuple[str | None, str | None, str | None]]:
        try:
            return [(*x, None) for x in backend(prompts, heat)]
        except (ValueError, OSError) as e:
            return [(None, None, str(e))] if len(prompts) == 1 else [x for p in prompts for x in ask([p], heat)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                prompts, expected = part.column(3).to_pylist(), part.column(4).to_pylist()
                got: list[tuple] = [(None, None, None)] * len(prompts)
                left = list(range(len(prompts)))
                for attempt in range(retries + 1):
                    for i, (text, finish, error) in zip(left, ask([prompts[i] for i in left], min(temperature * 2**attempt, 1.0)), strict=True):
                        got[i] = (text, finish, error or answer_error(text, finish, expected[i] or []))
                    left = [i for i in left if got[i][2]]
                    if not left:
                        break
                    if attempt < retries:
                        wait(2.0**attempt)
                columns = [pa.array(c, pa.string()) for c in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), *columns], names=["id", "mode", "metric", "expected", "result", "finish", "error"])

    return tasks.select("id", "mode", "metric", "prompt", "expected").mapInArrow(run, RESULT)


def validation_error(result: Column, finish: Column, expected: Column, reasons: tuple[str, ...] = ("reason",)) -> Column:
    """Null for a valid answer: a JSON object with the expected keys (any, if none are expected) and whole scores from 1 to 10. A reason's text is let pass."""
    m = F.map_filter(F.from_json(result, "map<string,string>"), lambda k, v: ~k.isin(*reasons))
    keys = F.map_keys(m)
    bad = F.exists(F.map_values(m), lambda v: ~F.coalesce(F.expr("1").cast("boolean") & v.rlike(r"^\s*[+-]?\d+\s*$") & v.cast("string").isNotNull(), F.lit(False)) | F.coalesce(~_small(v).between(1, 10), F.lit(True)))
    other = (F.size(F.array_except(keys, expected)) > 0) | (F.size(F.array_except(expected, keys)) > 0)
    return F.when(finish == "length", "cut off").when(finish == "content_filter", "filtered").when(m.isNull(), "no JSON object").when((F.size(expected) > 0) & other, "other keys").when(F.size(m) == 0, "empty").when(bad, "bad score")


def _small(v: Column) -> Column:
    """A whole number of at most four digits, else null."""
    return F.when(F.trim(v).rlike(r"^[+-]?\d{1,4}$"), F.trim(v)).try_cast("int")


def scores_of(result: Column) -> Column:
    return F.transform_values(F.map_filter(F.from_json(result, "map<string,string>"), lambda k, v: _small(v).isNotNull()), lambda k, v: _small(v))


def collect(called: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored (id, scores: mode.metric -> keys -> int) if any metric succeeded; errors; ids that are complete because all did.

    The answers are written to the shared folder first: the three tables come from one set of calls.
    """
    called, _ = shared_table(called, "judged")
    checked = called.withColumn("error", F.coalesce("error", validation_error(F.col("result"), F.col("finish"), F.col("expected"))))
    ok = checked.where("error is null").select("id", F.concat_ws(".", "mode", "metric").alias("what"), scores_of(F.col("result")).alias("s"))
    scored = ok.groupBy("id").agg(F.map_from_entries(F.array_sort(F.transform(F.collect_list(F.struct("what", F.map_entries("s").alias("e"))), lambda x: x))).alias("entries"))
    scored = scored.select("id", F.transform_values("entries", lambda k, v: F.map_from_entries(v)).alias("scores"))
    errors = checked.where("error is not null").select("id", "mode", "metric", "error")
    complete = checked.groupBy("id").agg(F.count("error").alias("bad")).where("bad = 0").select("id")
    return scored, errors, complete


def fold(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Keys of Q.All and QA.All go into Q_scores and QA_scores where those have the key; a code or math difficulty becomes Difficulty."""
    j = judged.select(F.col("id").alias("_jid"), "scores")
    d = records.join(j, F.col("id") == F.col("_jid"), "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    part = lambda k: F.coalesce(F.try_element_at("scores", F.lit(k)), none)
    hard = F.coalesce(F.try_element_at(part("Q.Code_Difficulty"), F.lit("Difficulty")), F.try_element_at(part("Q.Math_Difficulty"), F.lit("Difficulty")))
    take = lambda m, new: F.transform_values(m, lambda k, v: F.when((k == "Difficulty") & hard.isNotNull() & F.lit(m == "Q_scores"), hard.cast("double")).otherwise(F.coalesce(F.try_element_at(new, k).cast("double"), v)))
    return d.withColumns({"Q_scores": take("Q_scores", part("Q.All")), "QA_scores": take("QA_scores", part("QA.All"))}).drop("_jid", "scores")
