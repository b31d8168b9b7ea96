"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good (1), bad (0) or abstains (-1). How often a rule is right is not known; it is
estimated, together with the share of good documents, from how the rules agree over all documents: given a document's class the votes are
taken as independent, and every rule has one distribution over its three answers for good and one for bad documents. Only the
counts of distinct vote patterns reach the driver, at most three to the number of rules. A document is kept where the posterior
probability of good quality is ``KEEP`` or more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import saved, slices, unused

KEEP = 0.5
ROUNDS = 200
#: Where the estimation starts: share of good documents, and how often a good and a bad document gets (bad, no, good) votes of any rule.
START = 0.8, np.array([0.01, 0.15, 0.84]), np.array([0.4, 0.2, 0.4])
#: What is taken as known of any rule: the share of its bad votes among good and among bad documents stays in these bounds. A rule is
#: mostly right when it votes bad, and as each looks at one defect, none sees more than half of the bad documents.
BOUNDS = (1e-6, 0.01), (0.1, 0.5)
#: Imagined documents of each class that hold every rule near its start where few documents speak.
PRIOR = 5.0
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, n_upper long, n_alpha_words long, n_lines long, n_unique long"
SYMBOLS = "#*$%&|<>"
SPACE = re.compile("[^\x20\x09-\x0d]")
#: (expression, votes bad above, votes good up to); between the two, and on a null, a rule abstains.
RULES = {
    "length": ("-n_words", -30, -80),
    "word_size": ("abs(word_chars / nullif(n_words, 0) - 6.5)", 4.5, 3.0),
    "symbols": ("n_symbols / nullif(n_words, 0)", 0.1, 0.02),
    "lines": ("n_dup_lines / nullif(n_lines, 0)", 0.5, 0.2),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", 0.5, 0.2),
    "letters": ("-n_alpha_words / nullif(n_words, 0)", -0.7, -0.85),
    "capitals": ("n_upper / greatest(n_letters, 1)", 0.35, 0.12),
    "variety": ("-n_unique / pow(nullif(n_words, 0), 0.8)", -0.6, -1.0),
}


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(grams) < n - 2:
        covered = bytearray(n)
        for i, gram in enumerate(zip(words, words[1:], words[2:])):
            if grams[gram] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    unique = set(words)
    alpha = {w: w.decode().isalpha() or w[:-1].decode("utf-8", "ignore").isalpha() for w in unique}
    letters = sum(map(str.isalpha, text))
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, letters, upper, sum(map(alpha.__getitem__, words)), len(lines), len(unique)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text) and MEASURES of every row."""
    names = ["doc_id", "row", *(m.split()[0] for m in MEASURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = zip(*(measures(t) for t in batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, " + MEASURES)


def pattern(rules: dict[str, tuple[str, float, float]]) -> F.Column:
    """One character a rule: 0 bad, 1 no vote, 2 good."""
    votes = [F.when(F.expr(sql) > bad, "0").when(F.expr(sql) <= good, "2").otherwise("1") for sql, bad, good in rules.values()]
    return F.concat(*votes)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, answers of every rule [class, rule, answer], posterior of good for every pattern).

    ``votes`` holds distinct patterns of 0, 1, 2; ``counts`` how many documents have each.
    """
    share, good, bad = START
    rules = votes.shape[1]
    start = np.stack([np.tile(bad, (rules, 1)), np.tile(good, (rules, 1))])
    answers, column = start, np.arange(rules)
    posterior = np.zeros(len(votes))
    for _ in range(rounds):
        log = np.log(answers)[:, column, votes].sum(axis=2)
        odds = np.log(share) - np.log1p(-share) + log[1] - log[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done, posterior = np.abs(new - posterior).max() < 1e-9, new
        if done:
            break
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        seen = np.stack([(weight[:, :, None] * (votes == a)).sum(axis=1) for a in range(3)], axis=2) + PRIOR * start
        answers = seen / seen.sum(axis=2, keepdims=True)
        for kind, (low, high) in ((1, BOUNDS[0]), (0, BOUNDS[1])):
            votes_bad = np.clip(answers[kind, :, 0], low, high)
            answers[kind, :, 1:] *= ((1 - votes_bad) / (1 - answers[kind, :, 0]))[:, None]
            answers[kind, :, 0] = votes_bad
        share = (weight[1].sum() + PRIOR * START[0]) / (counts.sum() + PRIOR)
    return share, answers, posterior


def judged(docs: DataFrame, rules: dict[str, tuple[str, float, float]] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, MEASURES, base_failed, p_good and kept of every row of ``docs``.

    ``base_failed``: under 50 words, or over half of them in repeated three-word windows; such a document is never kept. A null or empty
    text has no words and fails. Null and repeated ids are judged like others; an empty table gives no rows.
    """
    rules = rules or RULES
    spark = docs.sparkSession
    rows = saved(measured(docs, id_col, text_col).withColumn("votes", pattern(rules)), "measures")
    counted = rows.groupBy("votes").count().collect()  # at most 3 ** len(rules) patterns
    known = []
    if counted:
        posterior = estimate(np.array([[int(c) for c in r.votes] for r in counted]), np.array([r["count"] for r in counted], float))[2]
        known = [(r.votes, float(p)) for r, p in zip(counted, posterior)]
    posteriors = spark.createDataFrame(known, "votes string, p_good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(posteriors), "votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep)).drop("votes")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were, whatever their names."""
    id_, row, text = (unused(docs, n) for n in ("kept_id", "kept_row", "kept_text"))
    # ids alone, written: Spark knows their size and only shuffles the documents where they are too many to send around
    kept = saved(judged(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(id_), F.col("row").alias(row)), "kept")
    rows = docs.withColumn(text, F.xxhash64(F.col(f"`{text_col}`")))
    return rows.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.col(text) == F.col(row)), "left_semi").drop(text)
