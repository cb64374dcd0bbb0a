"""What each model scorer reads: named text columns from instruction, input and output (and reference, context, answer).

``texts(scorer)`` gives the columns that go to its backend; ``functions.model_scores`` turns what comes back into scores. Chat markup of a model's own
tokenizer is the backend's business; formats below are those that don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, always_joined, field_text, record_text, stripped_fields

# Formats that published scorers were trained or are used with.
ASK = "Is the following data high quality? Please answer yes or no.\n\n"
DEITA_COMPLEXITY = "You are a helpful assistant. Please identify the complexity score of the following user query. \n##Query: {instruction}  \n##Complexity: "
DEITA_QUALITY = "You are a helpful assistant. Please identify the quality score of the Response corresponding to the Question. \n#Question#:\n{instruction}\n#Response#:\n{output} \n##Quality: "
TAGGER_SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
TAGGER_QUESTION = 'Please identify tags of user intentions in the following user query and provide an explanation for each tag. Please respond in the JSON format {"tag": str, "explanation": str}.\nUser query: '
CHAT_TURN = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n"
#: dimension -> question, and the texts that follow it, each after its name
UNIEVAL = {
    "summarization": {
        "coherence": ("Is this a coherent summary to the document?", ("summary", "output"), ("document", "source")),
        "consistency": ("Is this claim consistent with the document?", ("claim", "output"), ("document", "source")),
        "fluency": ("Is this a fluent paragraph?", ("paragraph", "output")),
        "relevance": ("Is this summary relevant to the reference?", ("summary", "output"), ("reference", "reference")),
    },
    "dialogue": {
        "naturalness": ("Is this a natural response in the dialogue?", ("response", "output")),
        "coherence": ("Is this a coherent response given the dialogue history?", ("response", "output"), ("dialogue history", "source")),
        "engagingness": ("Is this an engaging and informative response according to the dialogue history and fact?", ("response", "output"), ("dialogue history", "source"), ("fact", "context")),
        "groundedness": ("Is this response consistent with knowledge in the fact?", ("response", "output"), ("fact", "context")),
        "understandability": ("Is this an understandable response in the dialogue?", ("response", "output")),
    },
    "data2text": {
        "naturalness": ("Is this a fluent utterance?", ("utterance", "output")),
        "informativeness": ("Is this sentence informative according to the reference?", ("sentence", "output"), ("reference", "reference")),
    },
    "fact": {"consistency": ("Is this claim consistent with the document?", ("claim", "output"), ("document", "source"))},
}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _bare(c: str) -> Column:
    return F.regexp_replace(_text(c), rf"^[{SPACES}]+|[{SPACES}]+$", "")


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled at once: a value that holds such a place is left as it is."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def question() -> Column:
    """The instruction, and the input on a line of its own where there is one."""
    more = F.when(_text("input") != "", F.concat(F.lit("\n"), _text("input"))).otherwise("")
    return F.concat(_text("instruction"), more)


def bare_question() -> Column:
    """The same without white space around either."""
    more = F.when(_bare("input") != "", F.concat(F.lit("\n"), _bare("input"))).otherwise("")
    return F.concat(_bare("instruction"), more)


def _pair() -> dict[str, Column]:
    return {"question": question(), "answer": _text("output")}


def _asked(prompt: str = ASK) -> dict[str, Column]:
    return {"text": F.concat(F.lit(prompt), record_text(), F.lit("\n\n\n"))}


def _joined_if_given() -> Column:
    """The input takes a line even if empty, but none where it is null."""
    return F.concat_ws("\n", _text("instruction"), F.col("input"), _text("output"))


def _human() -> dict[str, Column]:
    return {"question": F.concat(F.lit("\n\nHuman: "), question(), F.lit("\n\nAssistant:")), "answer": _text("output")}


def _tagger() -> dict[str, Column]:
    return {"text": F.concat(F.lit(f"{TAGGER_SYSTEM} USER: {TAGGER_QUESTION}"), question(), F.lit(" ASSISTANT:"))}


def _followed(template: str = CHAT_TURN) -> dict[str, Column]:
    """The prompt in a chat turn, and the output that follows it."""
    return {"prompt": filled(template, instruction=question()), "output": _text("output")}


def _surprise() -> dict[str, Column]:
    return {"prompt": F.concat(question(), F.lit("\n")), "output": _text("output")}


def _one_shot(example_question: str = "example_question", example_output: str = "example_output") -> dict[str, Column]:
    """Prompt and full text, alone and after the nearest row's (as columns): losses on the output of both are compared."""
    alone = F.concat(F.lit("User: "), question(), F.lit("\nAssistant: "))
    shown = F.concat(F.lit("User: "), _text(example_question), F.lit("\nAssistant: "), _text(example_output), F.lit("\n"), alone)
    return {"prompt": alone, "full": F.concat(alone, _text("output")), "shown_prompt": shown, "shown_full": F.concat(shown, _text("output"))}


def _rated(ratings: tuple[str, ...] = ("Rate the response from 1 to 5.",)) -> dict[str, Column]:
    """A prompt for each rating instruction."""
    tail = F.concat(F.lit("\nInstruction:"), question(), F.lit("\nResponse:"), _text("output"), F.lit("\nThe answer is: \n"))
    return {"prompts": F.array(*(F.concat(F.lit(r.rstrip("\n")), tail) for r in ratings))}


def _gradient(separator: str = "\n") -> dict[str, Column]:
    return {"prompt": F.concat(bare_question(), F.lit(separator)), "output": _bare("output")}


def sentences(text: Column) -> Column:
    """Sentences by one regular expression: up to . ! or ? and what closes it. A text without such a sign is one."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"""[^.!?]+(?:[.!?]+["')\]]*|$)"""), F.lit(0)), lambda x: F.regexp_replace(x, rf"^[{SPACES}]+|[{SPACES}]+$", "")), lambda x: x != "")


def unieval(task: str) -> dict[str, Column]:
    """An array of yes/no questions for each dimension: one, but one per sentence of the output for a summary's consistency and fluency and a response's engagingness (whose answers are added up)."""
    source = F.regexp_replace(F.concat_ws("\n", _text("instruction"), F.when(_text("input") != "", F.col("input"))), rf"^[{SPACES}]+|[{SPACES}]+$", "")
    source = F.when(_text("input") != "", source).otherwise(_text("instruction"))
    if task == "dialogue":
        source = F.concat(source, F.lit("\n\n"))
    context = F.when(_text("context").endswith("\n"), _text("context")).otherwise(F.concat(_text("context"), F.lit("\n"))) if task == "dialogue" else None

    def asked(what: tuple, output: Column) -> Column:
        values = {"output": output, "source": source, "context": context}
        parts = [F.lit(f"question: {what[0]}")]
        for name, column in what[1:]:
            parts += [F.lit(f" </s> {name}: "), values[column] if column in values else _text(column)]
        return F.concat(*parts)

    per_sentence = {("summarization", "consistency"), ("summarization", "fluency"), ("fact", "consistency"), ("dialogue", "engagingness")}
    def of(what: tuple, many: bool) -> Column:
        return F.transform(sentences(_text("output")), lambda s: asked(what, s)) if many else F.array(asked(what, _text("output")))

    return {d: of(what, (task, d) in per_sentence) for d, what in UNIEVAL[task].items()}


_WHOLE = lambda: {"text": record_text()}
#: scorer -> its texts
TEXTS: dict[str, Callable[..., dict[str, Column]]] = {
    "ask_llm": _asked,
    "athene": _pair,
    "inform": _pair,
    "skywork_llama": lambda: {"question": F.concat_ws("\n", _text("instruction"), F.col("input")), "answer": _text("output")},
    "skywork_qwen": lambda: {"question": F.concat_ws("\n", _text("instruction"), F.col("input")), "answer": _text("output")},
    "rm_deberta": _pair,
    "gpt2_harmless": _human,
    "gpt2_helpful": _human,
    "deberta": _WHOLE,
    "fineweb_edu": lambda: {"text": always_joined()},
    "cleanliness": _WHOLE,
    "professionalism": _WHOLE,
    "readability": _WHOLE,
    "reasoning": _WHOLE,
    "textbook": lambda: {"text": F.regexp_replace(_joined_if_given(), "\n+", " ")},
    "qurate": _WHOLE,
    "deita_complexity": lambda template=DEITA_COMPLEXITY: {"text": filled(template, instruction=question())},
    "deita_quality": lambda template=DEITA_QUALITY: {"text": filled(template, instruction=bare_question(), output=_bare("output"))},
    "complexity": lambda template="{instruction}": {"text": filled(template, instruction=question())},
    "instag": _tagger,
    "ifd": _followed,
    "ppl": lambda: {"text": field_text()},
    "norm_loss": lambda compat=False: {"text": F.concat(_text("instruction"), F.lit("\n"), _text("output")) if compat else record_text()},
    "upd": _surprise,
    "thinking_prob": lambda: {"text": _text("instruction")},
    "hes": _pair,
    "miwv": _one_shot,
    "selectit_token": _rated,
    "selectit_sentence": _rated,
    "selectit_model": _rated,
    "unieval_d2t": lambda: unieval("data2text"),
    "unieval_dialog": lambda: unieval("dialogue"),
    "unieval_fact": lambda: unieval("fact"),
    "unieval_sum": lambda: unieval("summarization"),
    "grand": _gradient,
    "nuclear_norm": lambda: _gradient(" "),
    "effective_rank": _gradient,
    "embed_svd_entropy": lambda: {"text": stripped_fields()},
    "task2vec": _WHOLE,
    "fail_rate": lambda: {"question": question(), "answer": _text("answer")},
}


def texts(scorer: str, **params) -> dict[str, Column]:
    if scorer not in TEXTS:
        raise ValueError(f"{scorer!r} is none of {sorted(TEXTS)}")
    return TEXTS[scorer](**params)


def chunk_lengths(n_tokens: Column, size: int = 512) -> Column:
    """Token counts of the chunks of ``size`` tokens that a text is cut into."""
    full = F.floor(n_tokens / size).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.ceil(n_tokens / size).cast("int") - 1), lambda i: F.when(i < full, size).otherwise(n_tokens - full * size).cast("int"))
    return F.when(n_tokens > 0, some).otherwise(F.array().cast("array<int>"))
