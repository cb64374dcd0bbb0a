"""YAML plans: many pointwise scores in one projection, joined to what is done already."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merging import merge_pointwise, merge_setwise, resume
from ..sources.records import normalized_id, write_jsonl
from ..operators.backends import append_models
from .registry import MODELS, POINTWISE, ROWS, SETWISE, model_text


def _parse(text: str) -> dict:
    """YAML if the parser is installed, else the subset used here: scorers as a list of flow mappings, and plain key: value lines."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return _subset(text)


def _value(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def _flow(text: str) -> dict:
    out, depth, part, parts = {}, 0, "", []
    for c in text:
        depth += (c in "[{") - (c in "]}")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    for p in [*parts, part]:
        if ":" in p:
            k, v = p.split(":", 1)
            out[k.strip()] = _value(v)
    return out


def _subset(text: str) -> dict:
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("- ") and key:
            item = s[2:].strip()
            out.setdefault(key, []).append(_flow(item[1:-1]) if item.startswith("{") else _flow(item))
        elif line.startswith(" ") and key and out.get(key):
            out[key][-1] |= _flow(s)
        elif ":" in s:
            k, v = s.split(":", 1)
            key = k.strip()
            if v.strip():
                out[key] = _value(v)
            else:
                out[key] = []
    return out


@dataclass
class Step:
    name: str
    alias: str
    params: dict = field(default_factory=dict)


@dataclass
class ScorePlan:
    """Scorers by alias, so that one scorer may run twice with other parameters."""

    steps: list[Step]
    options: dict = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, text: str) -> ScorePlan:
        raw = _parse(text)
        steps, seen = [], set()
        for s in raw.get("scorers") or []:
            p = dict(s)
            name = p.pop("name")
            alias = p.pop("alias", name)
            if not any(name in x for x in (POINTWISE, SETWISE, ROWS, MODELS)):
                raise ValueError(f"unknown scorer {name!r}")
            if alias in seen:
                raise ValueError(f"alias {alias!r} is used twice")
            seen.add(alias)
            steps.append(Step(name, alias, p))
        return cls(steps, {k: v for k, v in raw.items() if k != "scorers"})

    def columns(self) -> dict[str, Column]:
        return {s.alias: POINTWISE[s.name](**s.params).cast("double") for s in self.steps if s.name in POINTWISE}

    def score(self, records: DataFrame, done: DataFrame | None = None, id_col: str = "id") -> DataFrame:
        """id and a column per pointwise scorer: one scan, one projection; rows that are done are left out first."""
        if done is not None:
            records = resume(records, done, id_col)
        return records.select(id_col, *(c.alias(a) for a, c in self.columns().items()))

    def scores_map(self, records: DataFrame, backends: Mapping[str, Callable] | None = None, id_col: str = "id") -> DataFrame:
        """id and a map of all pointwise and model scores that aren't null, in one pass over the records."""
        df, models = self._asked(records, backends or {})
        pairs = [x for a, c in (self.columns() | models).items() for x in (F.lit(a), c)]
        scores = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return df.select(id_col, F.map_filter(scores, lambda k, v: v.isNotNull()).alias("scores"))

    def _asked(self, records: DataFrame, backends: Mapping[str, Callable]) -> tuple[DataFrame, dict[str, Column]]:
        """The records with the answers of all backends, and each model scorer's score over them."""
        steps = [s for s in self.steps if s.name in MODELS]
        asked = {f"_{s.alias}": (model_text(MODELS[s.name].texts, **s.params), backends.get(s.alias) or backends[s.name], MODELS[s.name].kind) for s in steps}
        return append_models(records, asked) if asked else records, {s.alias: MODELS[s.name].score(F.col(f"_{s.alias}")).cast("double") for s in steps}

    def model_scores(self, records: DataFrame, backends: Mapping[str, Callable], id_col: str = "id") -> DataFrame:
        """id and a column per model scorer. ``backends``: alias or name -> what makes a backend in each task. All run in one pass over the records, without joins."""
        df, models = self._asked(records, backends)
        return df.select(id_col, *(c.alias(a) for a, c in models.items()))

    def rows(self, vectors: DataFrame) -> dict[str, DataFrame]:
        """(id, score) per scorer that needs the other rows too."""
        return {s.alias: ROWS[s.name](vectors, **s.params) for s in self.steps if s.name in ROWS}

    def run(self, records: DataFrame, out: str, vectors: DataFrame | None = None, backends: Mapping[str, Callable] | None = None, done: DataFrame | None = None) -> None:
        """Writes ``pointwise_scores`` (id, scores) and ``setwise_scores`` (scorer, result) as JSON lines under ``out``. vectors: (id, v, ...), which set-wise and row scorers read."""
        left = resume(records, done) if done is not None else records
        own = self.scores_map(left, backends) if any(s.name in POINTWISE or s.name in MODELS for s in self.steps) else None
        rows = self.rows(vectors) if vectors is not None else {}
        if rows:
            more = merge_pointwise(rows)
            if own is None:
                own = more
            else:
                none = F.create_map().cast("map<string,double>")
                joined = own.select(normalized_id("id").alias("id"), "scores").join(more.withColumnRenamed("scores", "more"), "id", "full")
                own = joined.select("id", F.map_concat(F.coalesce("scores", none), F.coalesce("more", none)).alias("scores"))
        if own is not None:
            write_jsonl(own, f"{out}/pointwise_scores")
        sets = {s.alias: SETWISE[s.name](records if s.name == "apjs" else vectors, **s.params) for s in self.steps if s.name in SETWISE}
        if sets:
            write_jsonl(merge_setwise(sets), f"{out}/setwise_scores")

    def setwise(self, vectors: DataFrame) -> dict[str, DataFrame]:
        """A one-row table per set-wise scorer, over the whole set."""
        return {s.alias: SETWISE[s.name](vectors, **s.params) for s in self.steps if s.name in SETWISE}
