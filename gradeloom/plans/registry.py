"""name -> operator, for YAML plans. Register more at will.

Pointwise ones give a Column from parameters, set-wise ones a one-row table from a table of vectors or records, row ones (id, score) from a
table, and model scorers what a backend is asked and what its answer means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assembly as X
from ..functions import model_scores as P
from ..functions import text as T
from ..operators import pointwise_udf as U
from ..operators import setwise as S

POINTWISE: dict[str, Callable[..., Column]] = {
    "str_length": lambda fields=(): F.length(T.field_text(*fields)),
    "logical_words": lambda words, mode="substring", fields=(): T.logical_words(T.field_text(*fields), list(words), mode),
    "think_or_not": lambda field="output": T.has_think(F.col(field)),
    "pure_think": lambda field="output": T.pure_think(F.col(field)),
    "gram_entropy": lambda: T.entropy_bits(T.grams(T.record_text())),
    "unique_ngram": lambda n=2: T.unique_share(T.ngrams(T.grams(T.record_text()), n)),
    "hdd": lambda sample_size=42: U.hdd(T.record_text(), sample_size),
    "mtld": lambda ttr_threshold=0.72: U.mtld(T.record_text(), ttr_threshold),
    "vocd_d": lambda ntokens=50, within_sample=100, seed=42: U.vocd(T.record_text(), ntokens, within_sample, seed),
    "compress_ratio": lambda level=9, fields=(): U.compress_ratio(T.field_text(*fields), level),
    "ts_python": lambda field="output": U.parses_as_python(F.col(field)),
    "token_length": lambda path=None, pattern=None, fields=(): _tokens(path, pattern)(T.field_text(*fields))["length"],
    "token_entropy": lambda path=None, pattern=None: _tokens(path, pattern)(T.record_text())["entropy"],
    "unique_ntoken": lambda n=2, path=None, pattern=None: _tokens(path, pattern, n)(T.record_text())["unique_share"],
    "tree_nodes": lambda heads="heads": U.tree_stats(F.col(heads))["nodes"],
    "tree_depth": lambda heads="heads": U.tree_stats(F.col(heads))["depth"],
}


def _tokens(path=None, pattern=None, n=2):
    from pyspark.sql import SparkSession

    return U.token_scores(SparkSession.active(), path, pattern, n)


SETWISE: dict[str, Callable[..., DataFrame]] = {
    "aps": lambda df, metric="cosine", sample_pairs=None: S.average_pair_similarity(df, metric, sample_pairs=sample_pairs),
    "radius": lambda df: S.radius(df),
    "partition_entropy": lambda df, cluster="label", num_clusters=None: S.partition_entropy(df, cluster, num_clusters),
    "vendi": lambda df, metric="cosine": S.vendi(df, metric=metric),
    "log_det": lambda df, ridge=1e-6: S.log_determinant(df, ridge=ridge),
    "novel_sum": lambda df, neighbors=(5, 10), density_powers=(0, 0.25, 0.5), distance_powers=(0, 1, 2): S.novelty_sum(df.select("id", "v"), tuple(neighbors), tuple(density_powers), tuple(distance_powers)),
    "task2vec": lambda df: S.task_distance(df),
    "apjs": lambda df, n=1, method="direct", num_perm=128, sample_pairs=None: S.jaccard_of_records(df, n, method, num_perm, sample_pairs),
    "cluster_inertia": lambda df, metric="squared_euclidean", label="label": S.inertia_report(df, label, metric),
    "facility_location": lambda df, subset="subset", metric="euclidean": S.facility_location(df.select("id", "v"), df.where(subset).select("id", "v"), metric),
}

#: (id, score) for every row, from a table of vectors.
ROWS: dict[str, Callable[..., DataFrame]] = {
    "knn": lambda df, k=5, metric="euclidean": S.knn_score(df.select("id", "v"), k, metric),
}


@dataclass(frozen=True)
class ModelScore:
    """``texts`` go to the backend as one string, parted by unit separators; ``score`` reads its answer: numbers, or text where ``kind`` says so."""

    texts: str
    score: Callable[[Column], Column]
    kind: str = "array<double>"


_ONE = lambda v: F.get(v, F.lit(0))
_HALVES = lambda v, f: f(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")))
_SIX = lambda v: F.coalesce(F.when(F.size(v) == 6, P.expected_class(v, 1)), F.lit(3.0))


def _unieval(task: str) -> Callable[[Column], Column]:
    """The mean of the dimensions, from the shares of yes to all questions in a row."""

    def score(v: Column) -> Column:
        asked = X.unieval(task)
        return P.choice_means(*P.dimension_scores(v, [F.size(c) for c in asked.values()], tuple(i for i, d in enumerate(asked) if d == "engagingness")))

    return score


#: What a backend answers: a reward; class logits; token losses; two lists in a row (scores and weights, or losses with and without the prompt).
MODELS: dict[str, ModelScore] = {
    "ask_llm": ModelScore("ask_llm", P.ask_yes),
    **{k: ModelScore(k, _ONE) for k in ("athene", "inform", "skywork_llama", "skywork_qwen", "rm_deberta", "gpt2_harmless", "gpt2_helpful", "fineweb_edu", "grand", "nuclear_norm", "effective_rank", "fail_rate")},
    "deberta": ModelScore("deberta", P.best_class),
    **{k: ModelScore(k, P.expected_class) for k in ("cleanliness", "professionalism", "readability", "reasoning")},
    "textbook": ModelScore("textbook", lambda v: P.three_level(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.get(v, F.lit(2)))),
    "qurate": ModelScore("qurate", lambda v: _HALVES(v, P.weighted_mean)),
    "deita_complexity": ModelScore("deita_complexity", _SIX),
    "deita_quality": ModelScore("deita_quality", _SIX),
    "complexity": ModelScore("complexity", P.parsed_level, "string"),
    "instag": ModelScore("instag", P.tag_count, "string"),
    "ifd": ModelScore("ifd", lambda v: _HALVES(v, P.follow_difficulty)),
    "ppl": ModelScore("ppl", P.perplexity),
    "norm_loss": ModelScore("norm_loss", P.bits_per_token),
    "upd": ModelScore("upd", lambda v, vocabulary=151_936: _HALVES(v, lambda a, b: P.surprise_difference(a, b, vocabulary))),
    "thinking_prob": ModelScore("thinking_prob", lambda v: P.thinking_probability(_ONE(v))),
    "hes": ModelScore("hes", P.high_entropy_sum),
    "miwv": ModelScore("miwv", lambda v: P.one_shot_gain(F.get(v, F.lit(0)), F.get(v, F.lit(1)))),
    **{k: ModelScore(k, P.steady_rating) for k in ("selectit_token", "selectit_sentence", "selectit_model")},
    **{k: ModelScore(k, _unieval(task)) for k, task in (("unieval_d2t", "data2text"), ("unieval_dialog", "dialogue"), ("unieval_fact", "fact"), ("unieval_sum", "summarization"))},
    "embed_svd_entropy": ModelScore("embed_svd_entropy", P.spectrum_entropy),
    "task2vec_vector": ModelScore("task2vec", lambda v: F.sqrt(P.mean(F.transform(v, lambda x: x * x)))),
}


def model_text(scorer: str, **params) -> Column:
    """Its texts as one string; lists of prompts are parted by record separators."""
    kinds = X.texts(scorer, **params)
    joined = [F.array_join(c, "\x1e") if scorer.startswith(("unieval", "selectit")) else c for c in kinds.values()]
    return F.concat(*(x for i, c in enumerate(joined) for x in ([F.lit("\x1f")] if i else []) + [c]))



def register(name: str, operator: Callable, setwise: bool = False) -> None:
    (SETWISE if setwise else POINTWISE)[name] = operator
