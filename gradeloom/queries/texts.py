"""The texts that each model scorer reads, with SQL for every one. Scorers' columns are joined by unit separators and hashed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assembly as X
from .base import REC, SPACES, T1, query, records

_Q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_BARE = lambda c: f"regexp_replace({c}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"
_N, _U = "chr(10)", "chr(31)"
ASKED = f"instruction || case when input <> '' then {_N} || input else '' end"
BARE = f"{_BARE('instruction')} || case when {_BARE('input')} <> '' then {_N} || {_BARE('input')} else '' end"
PAIR = f"({ASKED}) || {_U} || output"
CHAT = X.CHAT_TURN.split("{instruction}")
DC, DQ = X.DEITA_COMPLEXITY.split("{instruction}"), [y for x in X.DEITA_QUALITY.split("{instruction}") for y in x.split("{output}")]
ALONE = f"'User: ' || ({ASKED}) || {_N} || 'Assistant: '"
SHOWN = f"'User: ' || output || {_N} || 'Assistant: ' || instruction || {_N} || {ALONE}"
SOURCE = f"case when input <> '' then {_BARE(f'(instruction || {_N} || input)')} else instruction end"
RATINGS = ("Rate it.\n", "Is it good?")
SENTENCES = r"""list_filter(list_transform(regexp_extract_all(output, '[^.!?]+(?:[.!?]+["'')\]]*|$)'), lambda s: """ + _BARE("s") + "), lambda s: s <> '')"


def _unieval(task: str) -> str:
    source = SOURCE + (f" || {_N} || {_N}" if task == "dialogue" else "")
    context = f"case when ends_with(input, {_N}) then input else input || {_N} end"
    values = {"source": f"({source})", "reference": "instruction", "context": f"({context})"}
    out = []
    for d, (asked, *parts) in X.UNIEVAL[task].items():
        made = lambda o, a=asked, ps=parts: " || ".join([_Q(f"question: {a}"), *(f"' </s> {n}: ' || {o if c == 'output' else values[c]}" for n, c in ps)])
        many = (task, d) in {("summarization", "consistency"), ("summarization", "fluency"), ("fact", "consistency"), ("dialogue", "engagingness")}
        out.append(f"array_to_string(list_transform({SENTENCES}, lambda s: {made('s')}), chr(30))" if many else made("output"))
    return f" || {_U} || ".join(f"({x})" for x in out)


SQL = {
    "ask_llm": f"{_Q(X.ASK)} || {T1} || {_N} || {_N} || {_N}",
    **dict.fromkeys(("athene", "inform", "rm_deberta", "hes"), PAIR),
    **dict.fromkeys(("skywork_llama", "skywork_qwen"), f"instruction || {_N} || input || {_U} || output"),
    **dict.fromkeys(("gpt2_harmless", "gpt2_helpful"), f"{_N} || {_N} || 'Human: ' || ({ASKED}) || {_N} || {_N} || 'Assistant:' || {_U} || output"),
    **dict.fromkeys(("deberta", "cleanliness", "professionalism", "readability", "reasoning", "qurate", "task2vec", "norm_loss"), T1),
    "fineweb_edu": f"instruction || {_N} || input || {_N} || output",
    "textbook": f"regexp_replace(instruction || {_N} || input || {_N} || output, '\\n+', ' ', 'g')",
    "deita_complexity": f"{_Q(DC[0])} || ({ASKED}) || {_Q(DC[1])}",
    "deita_quality": f"{_Q(DQ[0])} || ({BARE}) || {_Q(DQ[1])} || {_BARE('output')} || {_Q(DQ[2])}",
    "complexity": ASKED,
    "instag": f"{_Q(f'{X.TAGGER_SYSTEM} USER: {X.TAGGER_QUESTION}')} || ({ASKED}) || ' ASSISTANT:'",
    "ifd": f"{_Q(CHAT[0])} || ({ASKED}) || {_Q(CHAT[1])} || {_U} || output",
    "ppl": f"concat_ws({_N}, nullif(instruction, ''), nullif(input, ''), nullif(output, ''))",
    "upd": f"({ASKED}) || {_N} || {_U} || output",
    "thinking_prob": "instruction",
    "miwv": f"{ALONE} || {_U} || {ALONE} || output || {_U} || {SHOWN} || {_U} || {SHOWN} || output",
    **dict.fromkeys(("selectit_token", "selectit_sentence", "selectit_model"), " || chr(30) || ".join(f"{_Q(r.rstrip(chr(10)))} || {_N} || 'Instruction:' || ({ASKED}) || {_N} || 'Response:' || output || {_N} || 'The answer is: ' || {_N}" for r in RATINGS)),
    "unieval_d2t": _unieval("data2text"),
    "unieval_dialog": _unieval("dialogue"),
    "unieval_fact": _unieval("fact"),
    "unieval_sum": _unieval("summarization"),
    **dict.fromkeys(("grand", "effective_rank"), f"({BARE}) || {_N} || {_U} || {_BARE('output')}"),
    "nuclear_norm": f"({BARE}) || ' ' || {_U} || {_BARE('output')}",
    "embed_svd_entropy": f"concat_ws({_N}, nullif({_BARE('instruction')}, ''), nullif({_BARE('input')}, ''), nullif({_BARE('output')}, ''))",
    "fail_rate": PAIR,
}


@query(f"with {REC} select id, " + ", ".join(f"md5({s}) {k}" for k, s in SQL.items()) + " from rec")
def model_texts(spark, sf_dir):
    """Reference, context and answer, and the nearest example of the one-shot scorer, are stood in for by the record's own fields."""
    r = records(spark, sf_dir).select("*", F.col("instruction").alias("reference"), F.col("input").alias("context"), F.col("output").alias("answer"), F.col("output").alias("example_question"), F.col("instruction").alias("example_output"))
    flat = lambda name, c: F.array_join(c, "\x1e") if name == "prompts" else c

    def column(k: str):
        params = {"ratings": RATINGS} if k.startswith("selectit") else {}
        found = X.texts(k, **params)
        parts = [F.array_join(c, "\x1e") if k.startswith("unieval") else flat(n, c) for n, c in found.items()]
        return F.md5(F.concat(*(x for i, p in enumerate(parts) for x in ([F.lit("\x1f")] if i else []) + [p]))).alias(k)

    return r.select("id", *map(column, SQL))


@query(f"with {REC}, n as (select id, length(output) n from rec) select id, array_to_string([case when i < n // 50 then 50 else n - 50 * (n // 50) end for i in range(0, ((n + 49) // 50)::bigint)], ',') chunks from n")
def chunk_lengths(spark, sf_dir):
    """Characters stand in for tokens, 50 for 512."""
    return records(spark, sf_dir).select("id", F.array_join(X.chunk_lengths(F.length("output"), 50), ",").alias("chunks"))
