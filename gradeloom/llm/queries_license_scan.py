"""Query op4_license_scan. No SQL: the automata are tested against a brute-force matcher."""

from .common import arrow_map
from .license_scan import BASE_PHRASES, TEMPLATES, scanner

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _rows(phrases, templates):
    scan = scanner(phrases, templates)

    def each(rows):
        out = []
        for doc_id, text in rows:
            x = scan(text)
            s = x["starts"]
            out.append((doc_id, x["n_words"], len(s), min(s, default=None), max(s, default=None), ",".join(x["base"]), ",".join(x["labels"]), x["score"]))
        return out

    return each


def license_scan(docs, phrases=None, templates=None):
    """One row per row of ``docs``, whatever its id: null and repeated ids stay as they are. A null or empty text has no words, no labels and score 0; an
    empty table gives no rows; texts of any length are scanned whole. The score is the share of words inside license wording."""
    return arrow_map(docs.select("doc_id", "text"), SCHEMA, _rows, phrases or BASE_PHRASES, templates or TEMPLATES)


def op4_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
